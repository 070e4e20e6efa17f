"""What records come to, against every set of answers tried one by one, and answers that are stored twice."""

from itertools import combinations

from pyspark.sql import functions as F

from evidentia.operators import holdout
from evidentia.plans import holdout as plans
from evidentia.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_fewest_answers_are_fewest(spark):
    """A record ships if a + b > 4 or d is 1: every set of answers by brute force."""
    rows = [(k, *v) for k, v in enumerate([(None, None, None), (5, 0, None), (None, 2, None), (1, None, None), (1, 1, 0), (None, None, 0), (None, None, 1), (2, 2, None)])]
    df = spark.createDataFrame(rows, "k long, a int, b int, d int")
    answers = {"a": 3, "b": 2, "d": 1}
    judge = lambda df, key: df.select(key, F.when((F.coalesce(F.col("a"), F.lit(0)) + F.coalesce(F.col("b"), F.lit(0)) > 4) | (F.coalesce(F.col("d"), F.lit(0)) == 1), "ok").otherwise("ask").alias("source"))
    got = {r.k: (r.source, r.asked) for r in holdout.least_asks(df, "k", {f: F.lit(x) for f, x in answers.items()}, judge, ["ok"]).collect()}
    fine = lambda v: (v["a"] or 0) + (v["b"] or 0) > 4 or v["d"] == 1
    for k, a, b, d in rows:
        v = {"a": a, "b": b, "d": d}
        blank = [f for f in answers if v[f] is None]
        sets = [list(s) for n in range(len(blank) + 1) for s in combinations(blank, n) if fine(v | {f: answers[f] for f in s})]
        assert got[k] == ("ok" if fine(v) else "ask", sets[0] if sets else None), k


def test_outcomes_of_parts(spark):
    rows = {r.p_partkey: r for r in plans.ship_outcomes(Tables(spark, SF)).collect()}
    assert len(rows) == 200
    for r in rows.values():
        assert r.ships_answered >= r.ships and (r.asked > 0) == (r.ships_answered and not r.ships) and (r.why == "") == r.ships
    assert {r.why.split(" ")[0].rstrip(":") for r in rows.values()} >= {"", "needs", "refused"}


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "answers")
    schema = "part string, field string, fingerprint string, stored_at long, number double"
    first = spark.createDataFrame([("p", "pitch", "f1", 1, 0.5), ("p", "span", "f2", 1, 6.0), ("q", "pitch", "f3", 1, None)], schema)
    later = spark.createDataFrame([("p", "pitch", "f1", 2, 0.65)], schema)
    for batch, df in (("run-0", first), ("run-1", later), ("run-0", first), ("run-1", later)):
        holdout.store_answers(df, path, batch)
    stored = holdout.stored_answers(spark, path)
    assert stored.count() == 4
    latest = {(r.part, r.field): r.number for r in holdout.latest_answers(stored, ["part", "field"]).collect()}
    assert latest == {("p", "pitch"): 0.65, ("p", "span"): 6.0, ("q", "pitch"): None}


def test_a_stream_retries_without_a_trace(spark, tmp_path):
    """foreachBatch with the batch's own number: what is written again replaces itself."""
    path, source = str(tmp_path / "answers"), str(tmp_path / "in")
    spark.range(20).select(F.col("id").cast("string").alias("part"), F.lit("pitch").alias("field"), F.col("id").cast("double").alias("number")).write.parquet(source)

    def twice(df, n):
        holdout.store_answers(df, path, f"q-{n}")
        holdout.store_answers(df, path, f"q-{n}")

    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    assert stream.writeStream.foreachBatch(twice).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination(120)
    assert holdout.stored_answers(spark, path).agg(F.count("*"), F.sum("number")).first() == (20, 190.0)


def test_records_of_answers(spark):
    said = [
        ("p", "pitch", 0.5, None, None, None, None), ("p", "form", None, "gullwing", None, None, None), ("p", "span", None, None, 5.8, 6.2, None), ("p", "pins", None, None, None, None, ["1", "2", "EP"]),
        ("q", "form", None, "wavy", None, None, None), ("q", "span", None, None, 6.2, 5.8, None), ("q", "pin_count", 8.0, None, None, None, None),
    ]
    df = spark.createDataFrame(said, "k string, field string, number double, words string, low double, high double, pins array<string>")
    rows = {r.k: r for r in holdout.record_from_answers(df, "k", ["pitch"], {"form": ["gullwing"], "name": None}, ["span"]).collect()}
    p, q = rows["p"], rows["q"]
    assert (p.pitch, p.form, p.span_min, p.span_max, p.pins, p.pin_count, p.name) == (0.5, "gullwing", 5.8, 6.2, ["1", "2"], 2, None)
    assert (q.pitch, q.form, q.span_min, q.span_max, q.pins, q.pin_count) == (None, None, None, None, None, 8)
