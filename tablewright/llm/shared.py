"""What the operators share: the shared folder, bounded samples, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tablewright

#: Buckets of the hash by which bounded samples are drawn.
SAMPLE_BUCKETS = 1 << 30


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where that may be unset, a local folder is made and set; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="tablewright-")
            context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _store(path: str) -> tuple[object, str]:
    url = urlparse(path)
    from pyarrow import fs

    return (fs.LocalFileSystem(), unquote(url.path)) if url.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def open_shared(path: str, mode: str) -> BinaryIO:
    """A file of the shared folder: local and mounted paths directly, other stores by pyarrow."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return open(unquote(url.path), mode)
    store, inner = _store(path)
    return store.open_output_stream(inner, compression=None) if "w" in mode else store.open_input_file(inner)


def make_shared(path: str) -> None:
    store, inner = _store(path)
    store.create_dir(inner, recursive=True)


def list_shared(path: str) -> list[str]:
    """Names of the files of a folder."""
    from pyarrow import fs

    store, inner = _store(path)
    return [x.base_name for x in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if x.is_file]


def remove_shared(path: str) -> None:
    """Remove a file or a folder with all it holds, if it exists."""
    from pyarrow import fs

    store, inner = _store(path)
    kind = store.get_file_info(inner).type
    if kind == fs.FileType.File:
        store.delete_file(inner)
    elif kind == fs.FileType.Directory:
        store.delete_dir(inner)


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder (a reliable checkpoint)."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame) -> DataFrame:
    """The same rows, written as a table in the shared folder and read from there.

    Unlike a checkpoint, the table has a size of its own. A checkpoint's is estimated from the plan behind it, where a join
    multiplies its sides' sizes, so that in a loop of joins the number doubles its digits each time and planning never ends.
    """
    path = new_shared_path(frame.sparkSession, "table")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def named(name: str) -> Column:
    """A column by its name, whatever signs that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, beside which an operator's own columns cannot clash; ``row.*`` gives them back."""
    return F.struct(*map(named, docs.columns)).alias("row")


def row_key(id_column: str, text_name: str) -> Column:
    """What tells rows apart: struct (none, id, hash) of the id, null ids last, and of the text, null as empty."""
    text = F.coalesce(named(text_name).cast("string"), F.lit(""))
    return F.struct(named(id_column).isNull().alias("none"), named(id_column).cast("bigint").alias("id"), F.xxhash64(text).alias("hash"))


def rows_of(docs: DataFrame, id_column: str, text_name: str, kept: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, one for each of the row keys (key) that are ``kept``; whole rows are moved once."""
    of = lambda key: [F.col(f"{key}.none").alias("none"), F.coalesce(F.col(f"{key}.id"), F.lit(0).cast("bigint")).alias("id"), F.col(f"{key}.hash").alias("hash")]
    rows = docs.select(whole_row(docs), row_key(id_column, text_name).alias("key")).select("row", *of("key")).dropDuplicates(["none", "id", "hash"])
    return rows.join(kept.select(*of("key")).distinct(), ["none", "id", "hash"], "left_semi").select("row.*")


def unplaced(number: Column) -> Column:
    """The same whole number, by an expression through which Spark does not follow a partitioning.

    A join on it exchanges both sides, and only then can Spark split the rows of a hot key among tasks; otherwise the side that
    was grouped by the key stays where it is.
    """
    return number.bitwiseXOR(F.lit(0).cast("bigint"))


def bernoulli(key: Column, seed: int, fraction: float) -> Column:
    """True for about ``fraction`` of the distinct keys, the same ones on every run."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(SAMPLE_BUCKETS))
    return bucket < F.lit(int(min(1.0, max(0.0, fraction)) * SAMPLE_BUCKETS))


def release_memory() -> None:
    """Return freed memory to the system, as far as the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application: nothing need be installed there."""
    context = spark.sparkContext
    if getattr(context, "_tablewright_shipped", False):
        return
    root = Path(tablewright.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="tablewright-code-")) / "tablewright.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    context._tablewright_shipped = True


def map_arrow(
    frame: DataFrame,
    step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | T.StructType,
) -> DataFrame:
    """``step`` over the Arrow batches of every partition, with this package's code at hand.

    Python workers outlive their tasks, so each task gives back what the allocators hold when it ends.
    """
    ship(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            release_memory()

    return frame.mapInArrow(run, schema)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of texts, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, mod ``folds``; a null key falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")
