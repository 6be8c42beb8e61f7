"""Column profiles: one pass for counts, extremes and moments; one aggregate of each column by itself for unique values and ranks."""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.functions.columns import as_number, is_instant, is_numeric, named, without_nan
from tablewright.sources.models import ColumnSummary, DataFrameReference, new_table_id
from tablewright.sources.together import together

PERCENTILES = (0.25, 0.5, 0.75)
#: Columns whose aggregates make one job, so that plans of wide tables stay small.
BLOCK = 64


def _comparable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BooleanType)) or is_numeric(kind) or is_instant(kind) or isinstance(kind, T.DayTimeIntervalType)


def _parts(frame: DataFrame, columns: Sequence[str], one: Callable[[DataFrame, int, str], DataFrame]) -> Iterator[DataFrame]:
    """What ``one`` makes of each column, a frame for up to BLOCK columns. Every column is scanned and grouped by itself, in its own type."""
    for at in range(0, len(columns), BLOCK):
        yield reduce(DataFrame.unionAll, (one(frame.select(named(c).alias("own")), i, c) for i, c in enumerate(columns) if at <= i < at + BLOCK))


def _uniques(frame: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct values of each column but null."""

    def one(values: DataFrame, i: int, c: str) -> DataFrame:
        nested = isinstance(frame.schema[c].dataType, (T.MapType, T.VariantType))
        return values.agg(F.lit(i).alias("c"), F.count_distinct(F.to_json("own") if nested else F.col("own")).alias("u"))

    return {columns[r["c"]]: r["u"] for block in _parts(frame, columns, one) for r in block.collect()}


def _ordered(frame: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> dict[str, tuple[int, list[float | None]]]:
    """Distinct values but null, and values at nearest ranks, of columns that are numbers in order.

    Values are counted, dealt by ranges of (column, value), and each range's size is told to the driver: at most a row for
    every range and one more for every column. Only the ranges that hold a wanted rank are then sorted.
    """

    def one(values: DataFrame, i: int, c: str) -> DataFrame:
        counts = values.where("own is not null").groupBy("own").agg(F.count(F.lit(1)).alias("n"))
        return counts.select(F.lit(i).alias("c"), as_number(F.col("own"), frame.schema[c].dataType).alias("v"), "n")

    found: dict[str, tuple[int, list[float | None]]] = {c: (0, [None] * len(fractions)) for c in columns}
    for block in _parts(frame, columns, one):
        dealt = block.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
        sizes: dict[int, list] = {}
        for r in dealt.groupBy("c", "part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("u")).orderBy("c", "part").collect():
            sizes.setdefault(r["c"], []).append(r)
        wanted = []
        for i, parts in sizes.items():
            total = sum(r["n"] for r in parts)
            found[columns[i]] = (sum(r["u"] for r in parts), [None] * len(fractions))
            for k, f in enumerate(fractions):
                at = math.floor((total - 1) * f + 0.5)
                for r in parts:
                    if at < r["n"]:
                        wanted.append((i, r["part"], k, at))
                        break
                    at -= r["n"]
        if wanted:
            marks = F.broadcast(frame.sparkSession.createDataFrame(wanted, "c int, part int, k int, at long"))  # a row a column and fraction
            held = dealt.join(F.broadcast(marks.select("c", "part").distinct()), ["c", "part"], "left_semi")
            run = F.sum("n").over(Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
            for r in held.withColumn("run", run).join(marks, ["c", "part"]).where("at < run and at >= run - n").select("c", "k", "v").collect():
                found[columns[r["c"]]][1][r["k"]] = r["v"]
        dealt.unpersist()
    return found


def nearest_ranks(frame: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> dict[str, list[float | None]]:
    """Values at index floor((n - 1) f + 1/2) of each sorted column (nulls left out, NaN last), never interpolated."""
    return {c: values for c, (_, values) in _ordered(frame, columns, fractions).items()}


def _moment(value: float | None, kind: T.DataType) -> float | str | None:
    """A statistic computed on microseconds, given back as the text of an instant."""
    if value is None or not is_instant(kind):
        return value
    if math.isnan(value):
        return None
    when = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=round(value))
    return when.date().isoformat() if isinstance(kind, T.DateType) and when.time() == datetime.time() else when.isoformat(sep=" ")


def describe(frame: DataFrame, column: str, percentiles: Sequence[float] = PERCENTILES) -> dict[str, float | str | int | None]:
    """count, null_count, mean, std, min, max and percentiles (keys such as "25%") of one column."""
    summary = profile(frame, [column])[0][column]
    out: dict[str, float | str | int | None] = {k: getattr(summary, k) for k in ("count", "null_count", "mean", "std", "min", "max")}
    if is_numeric(frame.schema[column].dataType):
        for f, v in zip(percentiles, nearest_ranks(frame, [column], percentiles)[column]):
            out[f"{f * 100:g}%"] = v
    return out


def profile(frame: DataFrame, columns: Sequence[str] | None = None, descriptions: dict[str, str] | None = None) -> tuple[dict[str, ColumnSummary], int]:
    """Summaries by column, and the number of rows.

    Unique values count null as one. Extremes skip NaN; mean and deviation don't. Instants report texts, texts their
    extremes only, nested and binary columns counts only.
    """
    columns = list(frame.columns) if columns is None else list(columns)
    aggs = [F.count(F.lit(1)).alias("n")]
    ranked = []
    for i, c in enumerate(columns):
        kind, x = frame.schema[c].dataType, named(c)
        aggs.append(F.count(x).alias(f"count{i}"))
        if _comparable(kind):
            low = without_nan(x, kind)
            shown = "double" if is_numeric(kind) else "string"
            aggs += [F.min(low).cast(shown).alias(f"min{i}"), F.max(low).cast(shown).alias(f"max{i}")]
        number = as_number(x, kind)
        if number is not None:
            aggs += [F.avg(number).alias(f"mean{i}"), F.stddev_samp(number).alias(f"std{i}")]
            if not isinstance(kind, T.BooleanType):
                ranked.append(c)
    row = frame.agg(*aggs).first().asDict()
    n = row["n"]
    others = [c for c in columns if c not in ranked]
    # after the first pass, which fills what a kept frame holds
    ranks, uniques = together([lambda: _ordered(frame, ranked, PERCENTILES), lambda: _uniques(frame, others)]) if n else ({}, {})
    found = {}
    for i, c in enumerate(columns):
        kind = frame.schema[c].dataType
        unique, quarter = ranks.get(c, (uniques.get(c, 0), [None] * 3))
        found[c] = ColumnSummary(
            description=(descriptions or {}).get(c, ""),
            dtype=kind.simpleString(),
            count=row[f"count{i}"],
            null_count=n - row[f"count{i}"],
            unique_count=unique + (n > row[f"count{i}"]),
            min=row.get(f"min{i}"),
            max=row.get(f"max{i}"),
            mean=_moment(row.get(f"mean{i}"), kind),
            std=row.get(f"std{i}"),
            **{p: _moment(v, kind) for p, v in zip(("p25", "p50", "p75"), quarter)},
        )
    return found, n


def reference_of(
    name: str, frame: DataFrame, *, description: str | None = None, column_descriptions: dict[str, str] | None = None, parent_ids: list[str] | None = None, source_query: str | None = None, table_id: str | None = None
) -> DataFrameReference:
    unknown = sorted(set(column_descriptions or {}) - set(frame.columns))
    if unknown:
        raise ValueError(f"descriptions of columns that the table lacks: {', '.join(unknown)}")
    summaries, rows = profile(frame, descriptions=column_descriptions)
    return DataFrameReference(
        id=table_id or new_table_id(), name=name, description=description or "", num_rows=rows, num_columns=len(frame.columns), column_names=list(frame.columns), column_summaries=summaries, parent_ids=parent_ids or [], source_query=source_query
    )
