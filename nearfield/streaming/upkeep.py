"""Structured Streaming upkeep: a stream of operations is logged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.sources.oplog import OpLog
from nearfield.sources.snapshot import Store


def stream_operations(ops: DataFrame, log: OpLog, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream of ``op, id[, vector][, metadata][, n]`` to the log.

    A batch that is repeated after a failure is written once: its number is noted beside the log
    before the next one begins, and the log's place is fixed by the first attempt.
    """
    marks = Store(log.spark, f"{checkpoint.rstrip('/')}/batches")

    def write(batch: DataFrame, number: int) -> None:
        if marks.exists(str(number)):
            return
        planned = f"{number}.first"
        first = int(marks.read(planned)) if marks.exists(planned) else log.next_sequence()
        marks.write(planned, str(first))
        if log.next_sequence() == first:
            log.append(batch)
        marks.write(str(number), "done")

    writer = ops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_counts(ops: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Operations by kind in windows of event time, with a watermark."""
    return ops.withWatermark(time, late).groupBy(F.window(time, width), "op").agg(F.count("*").alias("n"))
