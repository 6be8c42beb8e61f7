"""Running sums and ranks of a table in order, without gathering a group in one task.

Rows are dealt by ranges of (group, value); each range sums up on its own and starts from the totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@contextmanager
def running(rows: DataFrame, group: list[str], value: str, sums: list[str]) -> Iterator[DataFrame]:
    """``rows``, one per (group, value), with ``run_<sum>`` up to and with each row, and ``next_value`` (null at the end).

    The dealt rows are kept until the block ends, so that both uses see the same ranges.
    """
    dealt = rows.repartitionByRange(*group, value).withColumn("__range", F.spark_partition_id()).persist()
    part = Window.partitionBy("__range", *group).orderBy(value)
    inside = part.rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *(F.sum(s).over(inside).alias(f"__run_{s}") for s in sums), F.lead(value).over(part).alias("__next"))
    totals = dealt.groupBy("__range", *group).agg(*(F.sum(s).alias(f"__all_{s}") for s in sums), F.min(value).alias("__first"))
    over = Window.partitionBy(*group).orderBy("__range")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", *group, *(F.coalesce(F.sum(f"__all_{s}").over(before), F.lit(0)).alias(f"__before_{s}") for s in sums), F.lead("__first").over(over).alias("__following"))
    joined = local.join(starts, ["__range", *group])
    try:
        yield joined.select(*rows.columns, *((F.col(f"__run_{s}") + F.col(f"__before_{s}")).alias(f"run_{s}") for s in sums), F.coalesce("__next", "__following").alias("next_value"))
    finally:
        dealt.unpersist()
