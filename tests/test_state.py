"""State machines, settings and labels against rows written by hand, and texts with very many matches."""

import time

import pytest
from pyspark.sql import functions as F

from evidentia.operators import drawing, identity, packages, records, state

SF = "/root/testdata/sf0.001"


def rows_of(df, *names, by="i"):
    return [tuple(r[n] for n in names) for r in sorted(df.collect(), key=lambda r: r[by])]


def test_pacer_waits_move_later_requests(spark):
    """Two in a minute: the third waits for the first to be out of the window, and so the fourth for the second."""
    made = [(0, "a", 0), (1, "a", 1000), (2, "a", 2000), (3, "a", 3000), (4, "a", 200_000), (5, "b", 2500), (6, None, 7), (7, "a", None)]
    df = spark.createDataFrame(made, "i long, k string, t long")
    got = rows_of(state.pacer(df, "k", "t", ["t", "i"], 2), "sent", "waited")
    assert got == [(0, 0), (1000, 0), (60_250, 58_250), (61_250, 58_250), (200_000, 0), (2500, 0), (7, 0), (None, None)]


def test_single_flight_shares_the_flight_it_meets(spark):
    """The second joins and its own time doesn't count; a request at the very end leads anew."""
    made = [(0, "a", 0, 10), (1, "a", 4, 100), (2, "a", 9, 1), (3, "a", 10, 5), (4, "a", 15, 0), (5, "a", 15, 3), (6, "b", 4, 2), (7, "a", 17, None)]
    df = spark.createDataFrame(made, "i long, k string, t long, takes long")
    got = rows_of(state.single_flight(df, ["k"], "t", ["t", "i"], "takes", "i"), "leader", "until")
    assert got == [(0, 10), (0, 10), (0, 10), (3, 15), (4, 15), (5, 18), (6, 6), (5, 18)]


def test_store_of_lives_tombstones_and_recency(spark):
    made = [
        (0, "x", 0, True), (1, "y", 1, False), (2, "x", 2, None),  # x is the most recent
        (3, "z", 3, True),  # y goes, though a tombstone
        (4, "y", 4, False), (5, "x", 5, True),  # y pushed x out
        (6, "y", 6, True), (7, "y", 15, False),  # the tombstone answers, then is past its time
        (8, "x", 200, False),  # past its time
    ]
    df = spark.createDataFrame([("c", *r) for r in made], "c string, i long, k string, t long, found boolean")
    got = rows_of(state.resolution_store(df, "c", "k", "t", ["t", "i"], "found", 2, 100, 10), "outcome", "evicted", "held")
    assert got == [("fetch", 0, 1), ("fetch", 0, 2), ("hit", 0, 2), ("fetch", 1, 2), ("fetch", 1, 2), ("fetch", 1, 2), ("known_miss", 0, 2), ("fetch", 0, 2), ("fetch", 0, 2)]


def test_search_routes_around_open_breakers(spark):
    b, e, ok = "blocked", "error", "ok"
    made = [
        (0, 0, b, ok), (1, 1, b, e), (2, 2, b, None), (3, 3, ok, ok),  # the third block in a row opens the first
        (4, 4, ok, b), (5, 100, ok, b), (6, 101, None, None), (7, 102, e, e), (8, 103, b, e), (9, 104, e, b),
    ]
    df = spark.createDataFrame([("c", *r) for r in made], "c string, i long, t long, one string, two string")
    got = rows_of(state.searched(df, "c", "t", ["t", "i"], {"A": "one", "B": "two"}, 3, 50), "backend", "blocked", "route")
    assert got == [
        ("B", False, "blocked,ok"), (None, True, "blocked,error"), (None, True, "blocked,-"), ("B", False, "open,ok"),
        (None, True, "open,blocked"), ("A", False, "ok"), (None, True, "-,-"), (None, False, "error,error"), (None, True, "blocked,error"), (None, True, "error,blocked"),
    ]


@pytest.mark.parametrize("buckets", [1, 3, 1024])
def test_a_store_that_is_not_full_lets_nothing_go(spark, buckets):
    keys = spark.createDataFrame([(f"k{i}", i // 2, 0 if i % 5 == 0 else 9) for i in range(20)], "k string, seen long, until long")
    gone = lambda most: sorted((r.k, r.why) for r in state.evictions(keys, "k", "seen", "until", 5, most, buckets).collect())
    expired = [("k0", "expired"), ("k10", "expired"), ("k15", "expired"), ("k5", "expired")]
    assert gone(21) == [] and gone(20) == expired and gone(17) == expired
    assert gone(14) == sorted([*expired, ("k1", "oldest"), ("k2", "oldest"), ("k3", "oldest")])
    assert len(gone(1)) == 20
    assert state.evictions(keys.where("false"), "k", "seen", "until", 5, 0).count() == 0


def test_waits_that_a_service_states(spark):
    said = ["Please retry in 5.2s.", "no idea", "RETRY IN 500 s", None, "retry in 177.9s"]
    df = spark.createDataFrame(list(enumerate(said)), "i long, m string").select("i", state.retry_after_ms(F.col("m")).alias("w"))
    assert [r.w for r in sorted(df.collect())] == [7200, 45_000, 180_000, 45_000, 179_900]


def test_devices_in_labels(spark):
    """Families count as whole words only: parts whose numbers hold their letters are devices."""
    labels = ["ISO7741", "SC16IS750 and TOP223Y", "SO-16", "D (ABC1234)", "TSSOP14 SOT-23", "SOIC_W (dw0016a)", None, "lm358-q1 (TO-220)"]
    df = spark.createDataFrame(list(enumerate(labels)), "i long, label string")
    got = rows_of(df.select("i", identity.devices_named(F.col("label")).alias("d"), identity.is_this_part(F.col("label"), F.lit("iso-7741")).alias("mine")), "d", "mine")
    assert got == [(["ISO7741"], True), (["SC16IS750", "TOP223Y"], False), ([], True), (["ABC1234"], False), (["TSSOP14"], False), (["DW0016A"], False), ([], True), (["LM358Q1"], False)]


def test_settings_of_the_outermost_object(spark):
    raw = [
        '{"other":{"densityLevel":"A","formedLeadSpanMm":3.0}}', '{"formedLeadSpanMm":1e1,"formedLeadContactMm":"2"}', '{"densityLevel":["A"],"footprintSource":"standard-always"}',
        '{"densityLevel":"C","formedLeadSpanMm":200,"formedLeadContactMm":5.01}', "[1]", "nonsense", None, '{"formedLeadSpanMm":true,"densityLevel":"c"}', '{"note":"\\"densityLevel\\": \\"A\\"","formedLeadContactMm":0.5}',
    ]
    df = records.settings_resolved(spark.createDataFrame(list(enumerate(raw)), "i long, raw string"), "raw")
    blank = ("B", "datasheet-first", None, None, False)
    want = [blank, ("B", "datasheet-first", 10.0, None, False), ("B", "standard-always", None, None, False), ("C", "datasheet-first", 200.0, None, False), blank, blank, blank, blank, ("B", "datasheet-first", None, 0.5, False)]
    assert rows_of(df, "density", "source", "formedLeadSpanMm", "formedLeadContactMm", "complete") == want


def test_places_of_matches(spark):
    """Places and what is near, against Python's own search, over the ends of runs and blocks."""
    import re

    texts = ["", "none", "ab" * 3, "x" + "ab-" * 1000 + "é😀ab", "ab" * 40 + "z" * 700 + "ab", "q" * 511 + "ab" + "q" * 510 + "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", packages.occurrences(F.col("t"), "ab", 600, 5).alias("o"))
    for i, found in rows_of(df, "i", "o"):
        t = texts[i]
        assert [(o.m, o.place, o.near) for o in found] == [(m[0], m.start(), t[max(0, m.start() - 600) : m.start() + 5]) for m in re.finditer("ab", t)]


def test_many_matches_take_linear_time(spark):
    lines = [(0, "one SO8, and a TSSOP-14 x " * 10_000), (1, "Figure 2. LQFP64 - footprint example; " * 10_000), (2, "EXAMPLE BOARD LAYOUT\n8X (1.5) LAND PATTERN EXAMPLE " * 5_000)]
    df = spark.createDataFrame(lines, "k long, t string").withColumn("f", F.lit(None).cast("string")).coalesce(1)
    jobs = (lambda d: packages.package_variants(d, "k", "t"), lambda d: drawing.unreadable_footprints(d, "k", "t", F.col("f")), lambda d: drawing.land_patterns(d, "k", "t", F.col("f")))
    for run in jobs:
        run(df.limit(0)).collect()
        began = time.perf_counter()
        assert run(df).count() >= 1
        assert time.perf_counter() - began < 30  # 2,000 matches took as long before
    names = {(r.designator, r.place) for r in packages.package_variants(df, "k", "t").where("k = 0").collect()}
    assert names == {("SO8", 4), ("TSSOP-14", 15)}
