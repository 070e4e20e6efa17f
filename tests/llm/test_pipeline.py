"""The pipeline as a whole on odd tables: nulls, empty, blank and long texts, repeats, near copies, clashing columns, empty tables."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(400)]


def tables(spark, path, docs, items=()):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def kept(texts, items):
    """doc_ids that stay, by comparing everything with everything."""
    last = {}
    for k, t in texts:
        last[t or ""] = max(k, last.get(t or "", -1))
    rest = {k: t for t, k in last.items()}
    fps = {k: simhash.fingerprint(t) for k, t in rest.items()}
    root = {k: k for k in rest}
    for _ in rest:
        root = {k: min(root[j] for j in rest if bin(fps[k] ^ fps[j]).count("1") <= simhash.BITS) for k in rest}
    one = {k: rest[k] for k in rest if root[k] == k}
    return {k for k, t in one.items() if not any(i and f" {i} " in f" {t} " for i in items)}


def test_run_on_odd_tables(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base, item = prose(200), prose(30)
    texts = [None, "", " \n", "one", base, base, base.replace(" w", " w", 1) + " w1", prose(20_000), prose(60), prose(50) + " " + item + " " + prose(50), "é ß 漢字", prose(60)]
    rows = [(k, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("digest", "fp", "gone", "leak", "keep", "queue", "Place", "w")})
    path = tables(spark, tmp_path, df.union(df.where("doc_id = 8")), [item, "", None])
    pieces = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in pieces} == kept([(r[0], r[1]) for r in rows], [item])
    for k in {r.doc_id for r in pieces}:
        own = [r for r in pieces if r.doc_id == k]
        assert sum(r.length for r in own) == own[0].doc_tokens
    assert 9 not in {r.doc_id for r in pieces} and 8 in {r.doc_id for r in pieces}


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, spark.createDataFrame([], DOCS))).count() == 0
