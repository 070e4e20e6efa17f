"""Exact deduplication with a heavy-hitter split (operator 5).

Rows are keyed by the SHA-256 of their text, so only 32-byte digests travel. Misra-Gries summaries, one per
partition, find every digest that more than a set share of the rows carry; the candidates are counted exactly, and
the verified winners, a list whose length the share bounds, are broadcast: their rows are decided on the map side
and never shuffled. All other digests, none of them frequent, take an ordinary shuffle.

Defined results: a null text is an empty text; empty texts equal each other; of equal texts the row with the largest
doc_id stays (a null doc_id is smaller than any other; of identical rows any one stays); an empty table gives an
empty result; columns besides doc_id and text are ignored by the decisions and kept by drop_duplicates.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stage, table, texts_of

#: A digest is heavy if at least one row in HEAVY_ONE_IN carries it, and two do; so there are at most HEAVY_ONE_IN of them.
HEAVY_ONE_IN = 1024
#: Counters of each Misra-Gries summary: counts come out at most n / (COUNTERS + 1) too small.
COUNTERS = 4096


def shrink(counts: dict, counters: int) -> dict:
    """Misra-Gries: with more entries than counters, take the largest surplus entry's count off all and drop what is left of none."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: v - cut for k, v in counts.items() if v > cut}


def misra_gries(column: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One column of values to (value, estimate): estimates of partitions added up, each at most n / (counters + 1) too small."""
    name, kind = column.columns[0], column.schema[0].dataType.simpleString()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            for value, n in Counter(batch.column(0).to_pylist()).items():
                counts[value] = counts.get(value, 0) + n
            counts = shrink(counts, counters)
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.binary() if kind == "binary" else None), pa.array(counts.values(), pa.int64())], [name, "estimate"]
            )

    return column.mapInArrow(summarise, f"{name} {kind}, estimate long").groupBy(name).agg(F.sum("estimate").alias("estimate"))


def heavy_digests(rows: DataFrame, one_in: int, counters: int) -> DataFrame:
    """(digest, keep_id, group_size, keep_row, tied) of the frequent digests of rows (doc_id, digest, row), verified by exact counts.

    At most one_in rows. keep_row: of the rows with the largest doc_id the one with the largest `row`; tied: are there several?
    """
    n = rows.count()
    least = max(2, -(-n // one_in))
    found = misra_gries(rows.select("digest"), counters).where(F.col("estimate") > least - n / (counters + 1)).select("digest")
    candidates = F.broadcast(found)  # estimates add up to n at most: no more than 1 / (1/one_in - 1/(counters + 1)) rows
    last = F.max(F.struct("doc_id", "row"))
    exact = rows.join(candidates, "digest", "left_semi").groupBy("digest").agg(last.alias("last"), F.count(F.lit(1)).alias("group_size"))
    exact = stage(exact.where(F.col("group_size") >= least), "heavy")
    ties = rows.join(F.broadcast(exact.select("digest", F.col("last.doc_id").alias("keep_id"))), "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    ties = ties.groupBy("digest").agg((F.count(F.lit(1)) > 1).alias("tied"))
    winners = exact.join(F.broadcast(ties), "digest")
    return stage(winners.select("digest", F.col("last.doc_id").alias("keep_id"), "group_size", F.col("last.row").alias("keep_row"), "tied"), "winners")


def exact_duplicates(docs: DataFrame, heavy_one_in: int = HEAVY_ONE_IN, counters: int = COUNTERS) -> DataFrame:
    """Every row's decision: doc_id, digest (binary), keep_id, group_size, kept."""
    rows = texts_of(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    heavy = heavy_digests(rows, heavy_one_in, counters)
    group = Window.partitionBy("digest")
    light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "doc_id",
        "digest",
        F.max("doc_id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("doc_id").desc_nulls_last())) == 1).alias("kept"),
    )
    decided = rows.join(F.broadcast(heavy), "digest").withColumn("kept", F.col("row") == F.col("keep_row"))
    return decided.select(light.columns).unionByName(light)


def drop_duplicates(docs: DataFrame, heavy_one_in: int = HEAVY_ONE_IN, counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows of heavy groups go on the map side, before the shuffle; where several rows of one share the largest doc_id,
    one of them stays by an aggregation, which also begins on the map side.
    """
    digest, keep = free_name(docs, "digest"), free_name(docs, "keep")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)))
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(digest).alias("digest"))
    heavy = heavy_digests(stage(rows.withColumn("row", F.monotonically_increasing_id()), "digests"), heavy_one_in, counters)
    winners = heavy.select(F.col("digest").alias(digest), F.struct("keep_id", "tied").alias(keep))
    keyed = keyed.join(F.broadcast(winners), digest, "left")
    kept = keyed.where(F.col(keep).isNotNull() & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{keep}.keep_id")))
    single = kept.where(~F.col(f"{keep}.tied")).select(columns)
    tied = kept.where(F.col(f"{keep}.tied")).groupBy(digest).agg(F.first(F.struct(*columns)).alias(keep)).select(f"{keep}.*")
    order = Window.partitionBy(digest).orderBy(F.col("doc_id").desc_nulls_last())
    nth = free_name(keyed, "nth")
    light = keyed.where(F.col(keep).isNull()).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(columns)
    return single.union(tied).union(light)


def query(spark, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
