"""WARC archives: written as one gzip stream, normalised to one gzip member per record with an offset index.

A task writes the records of its partition as one monolithic gzip stream into the shared folder, inflates that stream
once (then it goes), rewrites every record as a member of its own and notes offset and length. Members are what readers
seek to; the notes are the sidecar index, a table and a JSON-lines file beside each archive.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import cut, list_shared, make_shared, map_arrow, new_shared_path, open_shared, remove_shared

CHUNK = 1 << 18
INDEX = "file string, position bigint, size bigint, record_id string, record_type string, payload_digest string"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of an Arrow batch that a task returns.
ROWS = 5_000


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of page ``refers_to`` (headers only)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{x:02X}" for x in c.encode("utf-8", "surrogatepass")) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class _Inflated:
    """The bytes of a gzip file, in one pass over its stream or streams."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.inflate, self.held = source, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        data = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        data = data or self.source.read(CHUNK)
        if not data:
            if not self.inflate.eof and self.held:
                raise EOFError("the archive ends within a stream")
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.held += self.inflate.decompress(data, 4 * CHUNK)
        return True

    def until(self, mark: bytes) -> bytes:
        """Up to and with the mark; empty at the end of the file."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                if self.held.strip():
                    raise EOFError("the archive ends within a header")
                return b""
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        found = bytes(self.held[:n])
        del self.held[:n]
        return found

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise EOFError("the archive ends within a record")
            piece = self.take(min(n, len(self.held)))
            n -= len(piece)
            yield piece


def normalise(source: BinaryIO, target: BinaryIO, level: int = 6) -> Iterator[dict]:
    """Rewrite a gzipped WARC, however it is split into members, with a member per record; yields the index."""
    stream, position = _Inflated(source), 0
    while head := stream.until(b"\r\n\r\n"):
        fields = headers(head.lstrip(b"\r\n"))
        deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
        size = target.write(deflate.compress(head.lstrip(b"\r\n")))
        for piece in stream.pieces(int(fields["content-length"]) + 4):
            size += target.write(deflate.compress(piece))
        size += target.write(deflate.flush())
        yield {"position": position, "size": size, "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "payload_digest": fields.get("warc-payload-digest")}
        position += size


def parse(member: bytes) -> dict:
    """A row of READ from one record's gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = headers(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    page = lambda x: None if x is None or x == "<urn:page:none>" else int(x.rpartition(":")[2].rstrip(">"))
    response = fields["warc-type"] == "response"
    return {
        "page_id": page(fields["warc-record-id"]),
        "payload_bytes": len(payload) if response else int(headers(http)["content-length"]),
        "payload_digest": digest_of(payload) if response else fields["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": fields["warc-type"],
        "refers_to": page(fields.get("warc-refers-to")),
    }


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for x in rows:
        held.append(x)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record into archives in ``folder``; returns INDEX.

    Of the records with equal payloads of ``min_bytes`` or more, the one with the largest page_id is a response and the
    others revisit it; rows that repeat that page_id with that payload are responses too. Null html is an empty
    payload, a null page_id is below all others and, where all are null, every record is a response; null urls are
    empty. Only digests meet in the shuffle that finds copies; a hot digest is summed up before it. The join that brings
    the answer back is a plain equi-join, which Spark splits where one digest is hot.
    """
    payload = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"))
    copies = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and kept is not null")
        .select(F.substring("sha1", 1, 40).alias("copy_sha1"), "kept")  # by an expression, so that both sides are exchanged and a hot digest can be split
    )
    told = rows.join(copies, rows["sha1"] == copies["copy_sha1"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("kept")), F.col("kept"))
    make_shared(folder)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
        stream = f"{name}.stream"
        try:
            with open_shared(stream, "wb") as whole:
                for batch in itertools.chain([first], batches):
                    for page, url, html, kept in zip(*(batch.column(i) for i in range(4))):
                        whole.write(deflate.compress(record(page.as_py(), url.as_py(), html.as_py().encode(), kept.as_py())))
                whole.write(deflate.flush())
            with open_shared(stream, "rb") as whole, open_shared(name, "wb") as target, open_shared(f"{name}.index.jsonl", "wb") as sidecar:

                def noted() -> Iterator[dict]:
                    for x in normalise(whole, target):
                        sidecar.write(json.dumps(x).encode() + b"\n")
                        yield {"file": name, **x}

                yield from _batches(noted(), pa.schema([("file", pa.string()), ("position", pa.int64()), ("size", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string())]))
        finally:
            remove_shared(stream)

    index = cut(map_arrow(told.select("page_id", "url", "payload", refers.alias("refers_to")), step, INDEX))
    good = {r["file"] for r in index.select("file").distinct().collect()}  # one for each task at most
    for file in list_shared(folder):  # attempts that were lost or ran twice
        if f"{folder}/{file.removesuffix('.index.jsonl')}" not in good:
            remove_shared(f"{folder}/{file}")
    return index


def read_archives(index: DataFrame) -> DataFrame:
    """A row of READ for every record of an index, from its own member."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            name, file = None, None
            try:
                for batch in batches:
                    for f, position, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                        if f != name:
                            if file is not None:
                                file.close()
                            name, file = f, open_shared(f, "rb")
                        file.seek(position)
                        yield parse(file.read(size))
            finally:
                if file is not None:
                    file.close()

        yield from _batches(rows(), pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return map_arrow(index.select("file", "position", "size"), step, READ)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of all pages in the shared folder, read back."""
    return read_archives(write_archives(pages, new_shared_path(pages.sparkSession, "warc"), min_bytes))
