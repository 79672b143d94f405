"""Registered queries over streams: events read in pages, and a table that a stream upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import stages
from textloom.plans.catalogue import query
from textloom.sources import paged
from textloom.sources.tables import parquet
from textloom.streaming import upserts


def _micros(ts: str) -> Column:
    """Of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def _service(spark: SparkSession, sf: str, folder: str) -> str:
    """The events as the service holds them, ordered by time."""
    return paged.laid_out(parquet(spark, sf, "events"), "ts", "event_id", f"{folder}/service")


def _pages(spark: SparkSession, service: str, first: int, until: int) -> DataFrame:
    spark.dataSource.register(paged.Paged)
    options = paged.options_for(spark, service, "ts", "event_id", 500, 86_400 * 5, first, until, paged.laid_out_pages)
    return spark.readStream.format("paged").options(**options).load()


def _parts(spark: SparkSession, sf: str, n: int) -> list[int]:
    """Seconds that cut the events' time into n parts."""
    second = F.floor(_micros("ts") / 1_000_000)
    low, high = parquet(spark, sf, "events").agg(F.min(second), F.max(second)).first()
    return [low + (high + 1 - low) * i // n for i in range(n + 1)]


@query("q57_paged_events", "SELECT event_id, epoch_us(ts) AS micros, user_id, event_type, value, props FROM events")
def _paged(spark: SparkSession, sf: str) -> DataFrame:
    folder, cuts = f"{stages.shared_folder(spark)}/paged-{uuid.uuid4().hex}", _parts(spark, sf, 2)
    service = _service(spark, sf, folder)
    for until in cuts[1:]:  # the second run goes on where the first one ended
        q = _pages(spark, service, cuts[0], until).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("event_id", _micros("ts").alias("micros"), "user_id", "event_type", "value", "props")


@query("q58_streamed_upsert", "SELECT user_id, event_id, event_type, value, epoch_us(ts) AS micros FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    folder, cuts = f"{stages.shared_folder(spark)}/upserts-{uuid.uuid4().hex}", _parts(spark, sf, 3)
    kept = ["user_id", "ts", "event_id", "event_type", "value"]
    schema = parquet(spark, sf, "events").select(*kept).schema
    table = upserts.UpsertedTable(spark, f"{folder}/table", schema, ["user_id"], ["ts", "event_id"])
    service = _service(spark, sf, folder)
    for until in cuts[1:]:
        table.run(_pages(spark, service, cuts[0], until).select(*kept), f"{folder}/state").awaitTermination()
    table.upsert(parquet(spark, sf, "events").select(*kept).withColumn("ts", F.expr("ts + INTERVAL 1 YEAR")), 0)  # a replayed batch changes nothing
    return table.read().select("user_id", "event_id", "event_type", "value", _micros("ts").alias("micros"))
