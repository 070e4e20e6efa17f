"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from evidentia.operators import state
from evidentia.sources.tables import table
from evidentia.streaming import state as streaming
from evidentia.streaming import store

SF = "/root/testdata/sf0.001"


def run(spark, make, name, source):
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_limiter(spark, tmp_path):
    events = table(spark, SF, "events").select("event_id", "user_id", F.unix_seconds("ts").alias("s"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    # a state with a timeout by the clock asks for another batch for ever; here the data end the run
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        got = run(spark, lambda s: streaming.fixed_window(s, "user_id", "s", "event_id", 2, 36000), "limited", str(tmp_path / "in"))
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    want = state.fixed_window(events, "user_id", "s", ["s", "event_id"], 2, 36000)
    pick = lambda df: sorted((r.event_id, r.allowed, r.retry_after) for r in df.collect())
    assert pick(got) == pick(want) and any(not r.allowed for r in want.collect())


def test_windows_close_behind_the_watermark(spark, tmp_path):
    table(spark, SF, "events").select("ts", "event_type").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(spark, lambda s: streaming.windowed_counts(s, "ts", ["event_type"], "1 day"), "counted", str(tmp_path / "in"))
    whole = table(spark, SF, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").count()
    want = {(r.w.start, r.event_type): r["count"] for r in whole.collect()}
    found = {(r.began, r.event_type): r.n for r in got.collect()}
    assert found and all(want[k] == n for k, n in found.items())


def in_two_runs(spark, rows, make, tmp_path, at):
    """What a stream of rows writes if it is stopped half-way and started again from its checkpoint."""
    half = rows.approxQuantile(at, [0.5], 0)[0]
    for part in (rows.where(F.col(at) < half), rows.where(F.col(at) >= half)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        out = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        assert out.trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_limiter_remembers_open_windows_over_a_restart(spark, tmp_path):
    """Windows of five days: the clock has moved seconds between the runs, the events days."""
    events = table(spark, SF, "events").select("event_id", (F.col("user_id") % 5).alias("user_id"), F.unix_seconds("ts").alias("s"))
    got = in_two_runs(spark, events, lambda s: streaming.fixed_window(s, "user_id", "s", "event_id", 3, 432_000), tmp_path, "s")
    want = state.fixed_window(events, "user_id", "s", ["s", "event_id"], 3, 432_000)
    pick = lambda df: sorted((r.event_id, r.allowed, r.retry_after) for r in df.collect())
    assert pick(got) == pick(want) and any(not r.allowed for r in want.collect())


def test_store_over_a_restart(spark, tmp_path):
    """Map state, a counter and a timer give what the fold over a whole history gives."""
    events = table(spark, SF, "events").select("event_id", "user_id", "event_type", "ts", F.unix_seconds("ts").alias("s"), F.coalesce(F.col("value") >= 20, F.lit(False)).alias("found"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = in_two_runs(spark, events, lambda s: store.resolution_store(s.withWatermark("ts", "0 seconds"), "event_type", "user_id", "s", "event_id", "found", 5, 900_000, 90_000), tmp_path, "s")
    finally:
        spark.conf.unset(provider)
    rows = state.resolution_store(events.withColumnRenamed("user_id", "user"), "event_type", "user", "s", ["s", "event_id"], "found", 5, 900_000, 90_000).collect()
    assert {r.request: r.outcome for r in got.collect()} == {r.event_id: r.outcome for r in rows}
    assert {r.outcome for r in rows} == {"fetch", "hit", "known_miss"} and any(r.evicted for r in rows)
