"""Incremental ingest: daily counts from a stream, idempotent appends, eligibility by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def activity_by_day(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str | None = "1 day") -> DataFrame:
    """(day, event_type, n), the same for a batch and a stream; a stream drops events later than the watermark."""
    rows = events.withWatermark(ts, late) if events.isStreaming and late else events
    g = rows.groupBy(F.window(ts, "1 day").alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), kind, "n")


def run_available(spark: SparkSession, path: str, name: str, checkpoint: str, query=activity_by_day, **options: str) -> DataFrame:
    """Runs a streaming query over what the folder holds now and returns its table."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).options(**options).parquet(path)
    out = query(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.table(name)


def ingest_new(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows of a batch whose key isn't known yet, one for each key."""
    return batch.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def eligible_comments(comments: DataFrame, posts: DataFrame, post: str, when: str, first: str, last: str) -> DataFrame:
    """Comments of posts whose own time is in the window, however late the comment itself is."""
    ok = posts.where((F.col(when) >= F.lit(first).cast("timestamp")) & (F.col(when) < F.lit(last).cast("timestamp")))
    return comments.join(ok.select(post, when), post)
