"""Names that tell packages apart, against all pairs and rows written by hand."""

import random

from pyspark.sql import functions as F

from evidentia.operators import entity


def test_containment_is_all_pairs(spark):
    """Names of one to nine letters of a small alphabet, repeated, in groups of very different size: every pair that contains, found by grams."""
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("AB1") for _ in range(rng.randint(0, 9)))
    left = [(rng.choice([1, 1, 1, 2, None]), k, rng.choice([name(), "AB1AB1", None])) for k in range(300)]
    right = [(rng.choice([1, 1, 1, 2, None]), 1000 + k, rng.choice([name(), "B1A", None])) for k in range(200)]
    got = entity.containing(spark.createDataFrame(left, "doc long, k long, name string"), spark.createDataFrame(right, "doc long, t long, name string"), ["doc"], "k", "t", "name")
    want = {}
    for d, k, a in left:
        hits = [t for e, t, b in right if d is not None and d == e and a and b and (a in b or b in a)]
        if hits:
            want[k] = (min(hits), max(hits))
    assert {r.k: (r.lo, r.hi) for r in got.collect()} == want and len(want) > 100


def test_containment_never_pairs_a_crowd(spark):
    """Ten thousand equal names on either side meet as one: no join sends out more rows than there are names."""
    named = lambda key, name: spark.range(10_000).select((F.col("id") % 1).alias("doc"), F.col("id").alias(key), F.concat(F.lit(name), F.col("id") % 1).alias("name"))
    left, right = named("k", "16 TSSOP"), named("t", "TSSOP")
    got = entity.containing(left, right, ["doc"], "k", "t", "name")
    assert got.agg(F.count("*"), F.min("lo"), F.max("hi")).first() == (10_000, 0, 9999)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


TABLES = [
    (1, 10, ["VQFN (RGT)"], None, 16), (1, 11, ["VQFN (RHB)"], None, 32), (1, 12, ["HVSSOP (DGN)"], "DGN0008G", 8), (1, 13, ["HVSSOP (DGN)"], "DGN0008H", 8), (1, 14, ["SOIC", "D"], None, None),
    (2, 20, ["TSSOP"], "MO-153 AB", 14), (2, 21, ["TSSOP"], "MO-153 AC", 16), (2, 22, ["LGA"], None, 20), (2, 23, None, None, 48),
]
ASKED = [
    (1, 0, "HVSSOP (DGN) [DGN0008H]", (13, 0)), (1, 1, "HVSSOP (DGN)", None), (1, 2, "VQFN (RGT) [XX]", (10, 1)),  # a code that names nothing goes; the name settles it
    (1, 3, "RGT (VQFN, 16)", (10, 3)), (1, 4, "VQFN", None), (1, 5, "soic-d", (14, 2)), (1, 6, "d", (14, 1)),
    (2, 7, "anything [MO-153]", None),  # two drawings: an answer that isn't one ends the search
    (2, 8, "16-lead TSSOP", (21, 4)), (2, 9, "48-pin WQFN", (23, 4)), (2, 10, "20-lead LGA", (22, 2)), (2, 11, "", None), (2, 12, None, None), (3, 13, "VQFN (RGT)", None),
    (2, 14, "TSSOP [mo-153_ac]", None), (2, 15, "TSSOP [MO-153 AC X]", (21, 0)),
]


def test_pin_tables_by_five_tiers(spark):
    tables = spark.createDataFrame(TABLES, "doc long, t long, names array<string>, outline string, pins long")
    asked = spark.createDataFrame([a[:3] for a in ASKED], "doc long, k long, designator string")
    got = {r.k: (r.t, r.tier) for r in entity.pin_tables_named(asked, tables, "doc", "k", "t").collect()}
    assert got == {k: want for _, k, _, want in ASKED if want}


def test_ladder_ambiguity(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, None, "y")], "k long, p string, q string")
    right = spark.createDataFrame([(7, "a", "y"), (8, "b", "z"), (9, "b", "x"), (9, "b", "x")], "t long, p string, q string")
    tiers = [(F.col("p"), F.col("p")), (F.col("q"), F.col("q"))]
    found = lambda vetoes: {r.k: (r.t, r.tier) for r in entity.ladder(left, right, "k", "t", tiers, vetoes).collect()}
    assert found(set()) == {1: (7, 0), 2: (9, 1), 3: (7, 1), 4: (7, 1)}
    assert found({0}) == {1: (7, 0), 3: (7, 1), 4: (7, 1)}


def test_labels_of_sets(spark):
    labels = ["DB, DGV, DW", "SOIC_W or TSSOP Packages", "TSSOP package", "SOIC / plastic", "", None, "A;B", "SOIC or oriented"]
    df = spark.createDataFrame(list(enumerate(labels)), "i long, s string").select("i", entity.names_several(F.col("s")).alias("n"))
    assert [r.n for r in sorted(df.collect())] == [True, True, False, False, False, False, True, False]
