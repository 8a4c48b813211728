"""Reliable file queues: at-least-once batches with retry and dead letters, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain(spark: SparkSession, source: str, schema: str, handle: Callable[[DataFrame], DataFrame], done: str, dead: str, checkpoint: str, max_files: int = 100, retries: int = 3):
    """Process everything queued as files once and stop; returns the finished query.

    ``handle`` maps a batch to rows with a boolean column ``ok``. Rows that fail are tried again, at most ``retries``
    times, then written to ``dead``. Output folders are named by batch, so a batch that is replayed after a crash
    overwrites what it wrote.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        left, good = df, []
        for _ in range(retries):
            tried = handle(left).persist()
            good.append(tried.where("ok").drop("ok"))
            left = tried.where("not ok").drop("ok")
            if left.isEmpty():
                break
        out = good[0]
        for g in good[1:]:
            out = out.unionByName(g)
        out.write.mode("overwrite").parquet(f"{done}/batch={batch_id}")
        left.withColumn("attempts", F.lit(retries)).write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def first_seen(events: DataFrame, keys: list[str], time: str, keep: str = "24 hours") -> DataFrame:
    """Rows of a stream whose keys weren't seen within ``keep``."""
    return events.withWatermark(time, keep).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, time: str, width: str, value: str, watermark: str = "1 minute") -> DataFrame:
    """Count and mean of a value by tumbling window."""
    return events.withWatermark(time, watermark).groupBy(F.window(time, width).alias("slot")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
