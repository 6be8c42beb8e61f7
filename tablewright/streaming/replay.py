"""A registered result for every micro-batch of a stream: an extension for tables that keep growing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablewright.agent.toolkit import DataFrameToolkit


def register_batches(toolkit: DataFrameToolkit, stream: DataFrame, name: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Register each micro-batch as ``<name>_<epoch>``. A batch that runs again after a failure replaces its table."""

    def register(batch: DataFrame, epoch: int) -> None:
        table = f"{name}_{epoch}"
        if any(r.name == table for r in toolkit.references):
            toolkit.unregister_dataframe(table)
        toolkit.register_dataframe(table, batch)

    writer = stream.writeStream.foreachBatch(register).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
