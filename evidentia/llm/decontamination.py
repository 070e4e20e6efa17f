"""Benchmark decontamination by size-partitioned MinHash containment search (operator 10), in DataFrame operations only.

A test item leaks into a document if the document contains at least `similarity` of the item's distinct five-word
shingles. Items are partitioned by size (powers of two of their shingle counts). An item's MinHash sketch is its k
smallest shingle hashes, with k set by its partition: more than the partition's largest item may lack and still
count, plus a margin. An item of n shingles may lack `spare` of them, so a document that contains it must contain
k - spare of its sketch, at least the margin or all but `spare`: the search loses nothing, whatever a document's
length, and needs no sketch of the documents, only their hashes one by one. Candidates then have all of their
shingles compared as strings.

An item of one to four words is one shingle of that length, and documents have shingles of every length that items have.

Defined results: words are runs of letters and digits in lower case; a null text is empty; an item without words is
contained in nothing; rows of documents or items that share an id are taken together; documents or items without an id
match as null ids of their own; empty tables give empty results; other columns are ignored, and kept by decontaminate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stage, table, texts_of

WORDS, SIMILARITY, MARGIN = 5, 0.8, 3


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def shingled(rows: DataFrame, key: str, lengths: list[int] | None = None, words: int = WORDS) -> DataFrame:
    """key, s: a struct of the words of each shingle, repeats included; of a shorter shingle the rest of s is null.

    lengths: of the shingles; without them those of `words` words, and a text with fewer words is one as a whole.
    """
    rows = rows.select(key, _words("text").alias("w")).where(F.size("w") > 0)
    if lengths is None:
        count = F.greatest(F.size("w") - (words - 1), F.lit(1))
        return rows.select(key, F.explode(F.arrays_zip(*(F.slice("w", k + 1, count).alias(f"w{k}") for k in range(words)))).alias("s"))

    def of(n: int) -> Column:
        count = F.greatest(F.size("w") - (n - 1), F.lit(0))
        nothing = F.array_repeat(F.lit(None).cast("string"), count)
        return F.arrays_zip(*((F.slice("w", k + 1, count) if k < n else nothing).alias(f"w{k}") for k in range(words)))

    return rows.select(key, F.explode(F.concat(*map(of, lengths)) if len(lengths) > 1 else of(lengths[0])).alias("s"))


def shingle_strings(words: Column, lengths: list[int]) -> Column:
    """array of the shingles of these lengths, as strings."""

    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.array_join(F.slice(words, k, F.lit(n)), " "))

    return F.concat(*map(of, lengths)) if len(lengths) > 1 else of(lengths[0])


def _hash(words: int) -> Column:
    return F.xxhash64(*(F.col(f"s.w{k}") for k in range(words)))


def _string(words: int) -> Column:
    return F.concat_ws(" ", *(F.col(f"s.w{k}") for k in range(words)))


def items_of(benchmark: DataFrame, words: int, similarity: float) -> DataFrame:
    """item_id, shingle, hash, length, n, need: the distinct shingles of each item, their words, their number, and how many a document must have."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    length = sum((F.when(F.col(f"s.w{k}").isNotNull(), 1).otherwise(0) for k in range(words)), F.lit(0)).alias("length")
    distinct = shingled(items, "item_id", words=words).select("item_id", _string(words).alias("shingle"), _hash(words).alias("hash"), length).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("item_id"))
    return distinct.withColumn("n", n).withColumn("need", F.ceil(F.col("n") * similarity - 1e-9))


def sketches(items: DataFrame, similarity: float, margin: int) -> DataFrame:
    """item_id, hash, hits: the k smallest hashes of each item, and how many of them a document must have."""
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double"))) + 1)  # of the item's partition
    k = F.floor(largest * (1 - similarity) + 1e-9) + margin
    ranked = items.dropDuplicates(["item_id", "hash"]).withColumn("nth", F.row_number().over(Window.partitionBy("item_id").orderBy("hash")))
    kept = ranked.where(F.col("nth") <= k)
    size = F.count(F.lit(1)).over(Window.partitionBy("item_id"))
    return kept.select("item_id", "hash", F.greatest(F.lit(1), size - (F.col("n") - F.col("need"))).alias("hits"))


def contained_items(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, margin: int = MARGIN) -> DataFrame:
    """doc_id, item_id, matched, item_shingles, containment: each item that each document contains to at least `similarity`."""
    texts = texts_of(docs)
    items = stage(items_of(benchmark, words, similarity), "items")
    sketch = stage(sketches(items, similarity, margin), "sketches")
    lengths = sorted(r.length for r in items.select("length").distinct().collect()) or [words]  # `words` at most
    hits = shingled(texts, "doc_id", lengths, words).select("doc_id", _hash(words).alias("hash")).join(sketch, "hash")
    per_pair = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("hash").alias("found"), F.first("hits").alias("hits"))
    candidates = stage(per_pair.where("found >= hits").select("doc_id", "item_id"), "candidates")
    # every shingle of the candidates, as a string: within the row of the document, so that no shingle is a key that many share
    chosen = candidates.select(F.col("doc_id").alias("id")).distinct()
    texts = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    texts = stage(texts.select(F.col("doc_id").alias("d"), _words("text").alias("w")), "candidate-words")  # words once, not once a shingle
    held = texts.select("d", shingle_strings(F.col("w"), lengths).alias("in_doc"))
    whole = items.groupBy(F.col("item_id").alias("i")).agg(F.collect_list("shingle").alias("in_item"), F.max("n").alias("n"), F.max("need").alias("need"))
    pairs = candidates.join(stage(whole, "whole-items"), F.col("item_id").eqNullSafe(F.col("i"))).join(held, F.col("doc_id").eqNullSafe(F.col("d")))
    same = pairs.select("doc_id", "item_id", "n", "need", F.explode(F.array_intersect("in_doc", "in_item")).alias("shingle"))
    verified = same.groupBy("doc_id", "item_id").agg(
        F.count_distinct("shingle").alias("matched"), F.max("n").alias("item_shingles"), F.max("need").alias("need")
    )
    return verified.where("matched >= need").select(
        "doc_id", "item_id", "matched", "item_shingles", (F.col("matched") / F.col("item_shingles")).alias("containment")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that contain no item, with all their columns. A row without a doc_id stays, as no decision can name it."""
    name = free_name(docs, "leak")
    leaks = stage(contained_items(docs, benchmark, words, similarity).select(F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.join(leaks, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w"


def leak_sql(source: str) -> str:
    """DuckDB: shingles of five words, of items with fewer words the whole of them, of documents those of every length that items have."""
    return f"""
WITH iw AS (SELECT item_id, {_SQL_WORDS} FROM benchmark), dw AS (SELECT doc_id, {_SQL_WORDS} FROM {source}),
     i AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS shingle
           FROM (SELECT item_id, w, least(len(w), 5) AS n FROM iw) WHERE n > 0),
     d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS shingle
           FROM dw, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
     t AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS matched, max(item_shingles) AS item_shingles, count(*) / max(item_shingles) AS containment
FROM d JOIN i USING (shingle) JOIN t USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= ceil(max(item_shingles) * 0.8e0 - 1e-9)
"""


SQL = leak_sql("documents")
