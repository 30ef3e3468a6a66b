"""Streaming twins of batch operators; each must equal its batch twin on the same input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.runtime import materialize


def daily_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", late: str = "2 days") -> DataFrame:
    """(day, kind, n): counts by day and kind; on a stream, rows later than ``late`` behind the watermark are dropped."""
    source = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        source = source.withWatermark("_t", late)
    return source.groupBy(F.window("_t", "1 day"), F.col(kind)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), kind, "n")


def once_per_key(stream: DataFrame, *, key: str, time: str, late: str) -> DataFrame:
    """First arrival of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def keyed_append(stream: DataFrame, target: str, *, key: str, time: str, store: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose key was never seen; a batch replayed after a failure appends nothing twice.

    Seen keys lie in a ``MessageStore``, so a batch reads the buckets whose filters answer, not the target.
    Each batch is one partition of the target, which a replay overwrites. Rows without key are appended.
    """
    from docketry.operators.redelivery import MessageStore

    def append(batch: DataFrame, number: int) -> None:
        seen = MessageStore(batch.sparkSession, store)
        rows = materialize(batch.withColumn("_row", F.monotonically_increasing_id()))
        new = seen.accept(rows, number, key="_row", ident=F.col(key).cast("string"), delivered=time)
        out = new.drop("_row").withColumn("_batch", F.lit(number).cast("bigint"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(target)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
