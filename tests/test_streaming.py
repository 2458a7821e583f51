import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.operators import state
from tessella.streaming import tiles as S

SCHEMA = "tile_id long, ts timestamp, event_id long, kind string, size long"


@pytest.fixture(scope="module")
def events():
    rng, start = random.Random(5), datetime(2024, 1, 1)
    return [(rng.randrange(6), start + timedelta(minutes=k), k, rng.choice(["loaded", "empty", "failed", "retry", "retry", "retry"]), rng.randrange(100)) for k in range(120)]


def test_stream_and_batch_agree(spark, events, tmp_path):
    folder = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(events[k * 40 : k * 40 + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = S.tile_states(source).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    last = {}
    for r in spark.table("states").orderBy("ts").collect():
        last[r.tile_id] = (r.state, r.retries, r.bytes)
    want = state.fold_events(spark.createDataFrame(events, SCHEMA), "tile_id", ["ts", "event_id"], F.col("kind"), F.col("size"))
    assert last == {r.tile_id: (r.state, r.retries, r.bytes) for r in want.collect()}


def test_rules():
    s = ("unloaded", 0, 0, None)
    for n in (1, 2, 3):
        s = S.advance(s, "retry", 0, n, 3)
        assert s[:2] == ("retry", n)
    s = S.advance(s, "retry", 0, 4, 3)
    assert s[0] == "failed" and S.advance(s, "loaded", 7, 5, 3)[:3] == ("loaded", 0, 7)


def test_backoff(spark):
    assert [r[0] for r in spark.range(9).select(state.backoff(F.col("id"))).collect()] == [1, 2, 4, 8, 16, 32, 64, 64, 64]


def test_stale_and_expired(spark):
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "tile_id long")
    held = spark.createDataFrame([(1, "loaded", 5, 10), (2, "loaded", 5, None), (3, "failed", 0, 1), (4, "loaded", 0, 1)], "tile_id long, state string, loaded_at long, max_age long")
    assert {r.tile_id for r in state.stale(ids(1), ids(2), held).collect()} == {3, 4}
    assert {r.tile_id for r in state.expired(held, F.lit(14)).collect()} == {4}


def test_windowed_counts_and_exact_delivery(spark, events, tmp_path):
    rows = events + events[:30]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = S.load_counts(source, "1 hour", "5 minutes").writeStream.outputMode("update").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == len(rows)
    query = S.first_of_each(source, "1 day").writeStream.outputMode("append").format("memory").queryName("firsts").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("firsts").count() == len(events)
