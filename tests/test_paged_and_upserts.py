"""Pages with ties on their borders, resumed streams, and upserts whose batches are replayed or cut off."""

import datetime
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.sources import paged
from textloom.streaming import upserts


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Up to 60 events in one second, and empty stretches."""
    path = str(tmp_path_factory.mktemp("paged") / "events.parquet")
    rows, i = [], 0
    for second, n in [(1000, 3), (1001, 60), (1002, 1), (1003, 10), (1500, 10), (1501, 9), (1999, 20), (3000, 5)]:
        for k in range(n):
            rows.append((i, datetime.datetime.fromtimestamp(second + k / 100, datetime.UTC), "ab"[k % 2]))
            i += 1
    spark.createDataFrame(rows, "event_id long, ts timestamp, kind string").orderBy(F.rand(1)).repartition(2).write.parquet(path)
    return path


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_pages_by_hand():
    rows = [(s, i) for i, s in enumerate([5, 5, 6, 6, 6, 6, 6, 7, 9, 9])]
    asked = []

    def fetch(after, before, limit):
        asked.append((after, limit))
        return pa.table({"s": [s for s, _ in rows if after <= s < before][:limit], "i": [i for s, i in rows if after <= s < before][:limit]})

    for limit in range(1, 12):
        for until in (6, 7, 8, 10):
            got = [i for t in paged.pages(fetch, lambda t: t.column("s"), 0, until, limit) for i in t.column("i").to_pylist()]
            assert got == [i for s, i in rows if s < until]
    asked.clear()
    list(paged.pages(fetch, lambda t: t.column("s"), 0, 10, 4))
    assert asked == [(0, 4), (6, 4), (6, 8), (9, 4)]


@pytest.mark.parametrize("page", [1, 7, 10, 1000])
def test_batch(spark, events, page):
    spark.dataSource.register(paged.Paged)
    for first, until, span in [(0, 4000, 100_000), (0, 4000, 500), (1001, 1500, 1)]:
        got = spark.read.format("paged").options(**paged.options_for(spark, events, "ts", "event_id", page, span, first, until)).load()
        want = spark.read.parquet(events).where((F.unix_seconds("ts") >= first) & (F.unix_seconds("ts") < until))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stream_goes_on(spark, events, tmp_path):
    spark.dataSource.register(paged.Paged)
    for until in (1001, 1502, 1502, 4000):  # the third run has nothing to read
        stream = spark.readStream.format("paged").options(**paged.options_for(spark, events, "ts", "event_id", 10, 400, 0, until)).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert ids(spark.read.parquet(str(tmp_path / "out"))) == ids(spark.read.parquet(events).where(F.unix_seconds("ts") < until))


SCHEMA = "k string, n long, v string"


def test_upserts(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    t = upserts.UpsertedTable(spark, str(tmp_path / "t"), schema, ["k"], ["n"], buckets=3)
    assert t.read().count() == 0
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    rows = lambda: sorted((r.k, r.n, r.v) for r in t.read().collect())
    t.upsert(batch(("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y"), (None, 9, "z")), 0)
    assert rows() == [("a", 2, "y"), ("b", 1, "x")]
    t.upsert(batch(("b", 5, "new"), ("a", 1, "late"), ("c", 1, None)), 1)
    want = [("a", 2, "y"), ("b", 5, "new"), ("c", 1, None)]
    assert rows() == want
    for replayed in (0, 1):  # even with other rows, what is done is done
        t.upsert(batch(("a", 99, "again")), replayed)
        assert rows() == want
    t.upsert(batch(), 2)
    assert rows() == want
    # A batch that was cut off after its files and before its manifest.
    publish, t._publish = t._publish, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        t.upsert(batch(("d", 1, "half")), 3)
    assert rows() == want
    t._publish = publish
    t.upsert(batch(("d", 1, "whole")), 3)
    assert rows() == [*want, ("d", 1, "whole")]
    assert json.loads((tmp_path / "t" / "manifests" / f"{3:020d}.json").read_text())


def test_known_ids_are_skipped(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    t = upserts.UpsertedTable(spark, str(tmp_path / "t"), schema, ["k"], ["n"], first_wins=True)
    t.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA), 0)
    t.upsert(spark.createDataFrame([("a", 9, "y"), ("b", 1, "z")], SCHEMA), 1)
    assert sorted((r.k, r.n, r.v) for r in t.read().collect()) == [("a", 1, "x"), ("b", 1, "z")]


def test_streamed_upsert(spark, events, tmp_path):
    source = spark.read.parquet(events)
    source.repartition(6).write.parquet(str(tmp_path / "in"))
    t = upserts.UpsertedTable(spark, str(tmp_path / "t"), source.select("kind", "ts", "event_id").schema, ["kind"], ["ts", "event_id"])
    for _ in range(2):
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        assert t.run(stream, str(tmp_path / "state")).awaitTermination(120)
    want = source.groupBy("kind").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    assert sorted((r.kind, r.event_id) for r in t.read().collect()) == sorted((r.kind, r.event_id) for r in want.collect())
    assert t._manifest()[0] == 2


@pytest.mark.parametrize("page", [1, 7, 1000])
def test_laid_out_table_gives_the_same_pages(spark, events, tmp_path, monkeypatch, page):
    laid = paged.laid_out(spark.read.parquet(events), "ts", "event_id", str(tmp_path / "service"))
    want, got = ({"path": p, "time": "ts", "id": "event_id"} for p in (events, laid))
    for after, before in [(0, 4000), (1001, 1500), (1002, 1003), (1600, 1900), (3000, 3001), (5000, 6000)]:
        assert paged.laid_out_pages(got, after, before, page).column("event_id").to_pylist() == paged.table_pages(want, after, before, page).column("event_id").to_pylist()
    spark.dataSource.register(paged.Paged)
    read = spark.read.format("paged").options(**paged.options_for(spark, laid, "ts", "event_id", page, 500, 0, 4000, paged.laid_out_pages)).load()
    assert sorted(map(str, read.collect())) == sorted(map(str, spark.read.parquet(events).collect()))


def test_laid_out_pages_read_what_they_hold(spark, tmp_path, monkeypatch):
    """Pages over a whole table read each row group about once, not all that is left each time."""
    monkeypatch.setattr(paged, "_GROUP_BYTES", 1 << 12)
    rows = spark.range(40_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") % 9_973).alias("ts"), F.lit(None).cast("string").alias("kind"))
    laid = paged.laid_out(rows, "ts", "event_id", str(tmp_path / "service"))
    asked, read = {"path": laid, "time": "ts", "id": "event_id"}, 0
    groups = paged._groups(laid)[0]
    assert len(groups) > 20
    paged._group.cache_clear()
    got = [i for p in paged.pages(lambda a, b, n: paged.laid_out_pages(asked, a, b, n), lambda t: t.column("_second"), 0, 10_000, 100) for i in p.column("event_id").to_pylist()]
    assert sorted(got) == list(range(40_000)) and paged._group.cache_info().misses == len(groups)
