"""Claims that only count where a document says so: citation, merging by precedence, gates on provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def cited(claims: DataFrame, pages: DataFrame, claim: str, value: str, keys: list[str], page_text: str, block: int = 4) -> DataFrame:
    """keys, claim: pages whose single-spaced text contains the claim's value at word boundaries.

    A containment join would be a product of both sides. A value of `block` words or more can only stand where its
    first `block` words do, so both sides meet on those (shorter values on their first word), and only pairs that share
    them are compared as a whole. Texts take no part in the first exchange, only their runs of words that begin a claim.
    """
    c = claims.select(claim, T.words(F.col(value)).alias("_v")).where("_v != ''").withColumn("_w", F.split("_v", " ")).withColumn("_long", F.size("_w") >= block)
    c = c.withColumn("_key", F.concat_ws(" ", F.slice("_w", F.lit(1), F.when(F.col("_long"), block).otherwise(1)))).drop("_w")
    words = pages.select(*keys, F.split(T.words(F.col(page_text)), " ").alias("_w"))
    runs = words.where(F.size("_w") >= block).select(*keys, F.explode(F.arrays_zip(*(F.slice("_w", k + 1, F.size("_w") - (block - 1)).alias(f"w{k}") for k in range(block)))).alias("s"))
    runs = runs.select(*keys, F.concat_ws(" ", *(F.col(f"s.w{k}") for k in range(block))).alias("_key"))
    begun = runs.join(c.where("_long").select(claim, "_key"), "_key").select(*keys, claim)
    short = c.where("not _long").select(claim, "_key")
    if not short.isEmpty():  # single words are frequent: they are only looked at where a claim begins with them
        singles = words.select(*keys, F.explode(F.array_distinct("_w")).alias("_key"))
        begun = begun.union(singles.join(short, "_key").select(*keys, claim))
    begun = begun.distinct()
    # only pages with a candidate send their text
    texts = pages.join(begun.select(*keys).distinct(), keys, "left_semi").select(*keys, F.concat(F.lit(" "), T.words(F.col(page_text)), F.lit(" ")).alias("_t"))
    found = begun.join(c.select(claim, "_v"), claim).join(texts, keys)
    return found.where(F.contains("_t", F.concat(F.lit(" "), F.col("_v"), F.lit(" ")))).select(*keys, claim)


def match_ratio(names: DataFrame, pages: DataFrame, keys: list[str], page: str, name: str, text: str) -> DataFrame:
    """keys, page, found, names, ratio: the part of each key's distinct names (two letters at least) that a page's words contain."""
    wanted = names.where(F.length(name) >= 2).select(*keys, F.col(name).alias("_name")).distinct()
    total = wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("names"))
    there = pages.select(*keys, page, F.explode(F.array_distinct(F.split(T.words(F.col(text)), " "))).alias("_name"))
    hits = there.join(wanted, [*keys, "_name"]).groupBy(*keys, page).agg(F.count(F.lit(1)).alias("found"))
    return hits.join(total, keys).withColumn("ratio", F.col("found") / F.col("names"))


def sole_page(ratios: DataFrame, keys: list[str], page: str, score: str, whole: str) -> DataFrame:
    """keys, page: the page with the single best score, if that is more than half of the whole; no page where two tie or none has a majority."""
    w = Window.partitionBy(*keys)
    best = ratios.withColumn("_rank", F.rank().over(w.orderBy(F.col(score).desc()))).where("_rank = 1").withColumn("_n", F.count(F.lit(1)).over(w))
    return best.where((F.col("_n") == 1) & (2 * F.col(score) > F.col(whole))).select(*keys, page, score, whole)


def merged(base: DataFrame, claims: DataFrame, keys: list[str], value: str = "value", citation: str = "citation", drawn: str = "drawn") -> DataFrame:
    """Gap-only merge: a base value stands; else the claim's, at confidence .5 if quoted, .4 if drawn, none if uncited."""
    b = base.select(*keys, F.col(value).alias("_b"))
    c = claims.select(*keys, F.col(value).alias("_c"), F.col(citation).alias("_page"), F.col(drawn).alias("_drawn"))
    rows = b.join(c, keys, "full_outer")
    taken = F.col("_b").isNull() & F.col("_c").isNotNull()
    confidence = F.when(F.col("_b").isNotNull(), 1.0).when(~taken, None).when(F.col("_page").isNotNull(), 0.5).when(F.col("_drawn"), 0.4)
    method = F.when(F.col("_b").isNotNull(), "deterministic").when(taken, F.when(F.col("_page").isNull() & F.col("_drawn"), "vlm-drawing").otherwise("vlm"))
    return rows.select(*keys, F.coalesce("_b", "_c").alias(value), confidence.alias("confidence"), method.alias("method"), F.when(taken, F.col("_page")).alias(citation))


def untraceable(value: Column, method: Column, citation: Column) -> Column:
    """A value that a model gave and nothing cites."""
    return F.coalesce(value.isNotNull() & F.startswith(method, F.lit("vlm")) & citation.isNull(), F.lit(False))


def resolved(rows: DataFrame, key: str, field: str, required: list[str], value: str = "value") -> DataFrame:
    """key, missing, untraceable, ok: the required fields without a value, the fields nothing cites, and whether neither exists."""
    empty = F.array_sort(F.collect_set(F.when(F.col(value).isNull() & F.col(field).isin(required), F.col(field))))
    loose = F.array_sort(F.collect_set(F.when(untraceable(F.col(value), F.col("method"), F.col("citation")), F.col(field))))
    return rows.groupBy(key).agg(empty.alias("missing"), loose.alias("untraceable")).withColumn("ok", (F.size("missing") == 0) & (F.size("untraceable") == 0))


def stated_maximum(text: Column, pattern: str, most: float) -> Column:
    """The one plausible number that a text states, or null where it states none or several."""
    found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("double")), lambda x: (x > 0) & (x <= most)))
    return F.when(F.size(found) == 1, found[0])


def located(claims: DataFrame, sent: DataFrame, tampered: DataFrame, printed: DataFrame, keys: list[str], quoted: str, page: str) -> DataFrame:
    """claims with citation, tier and confidence: the page that shows a claim, by the first rule that holds.

    text: the claimed page's text quotes it; rendered: the page was shown to the model as an image, and nobody tampered
    with its text; printed: the number is the one printed in the footer of a single page that was; pinout: a pin table
    belongs to the document's sole pinout page. sent and tampered: keys, page; printed: keys, printed, page.
    """
    flag = lambda df, name: df.select(*keys, F.col(page).alias(f"_p_{name}"), F.lit(True).alias(f"_{name}")).distinct()
    on = lambda col_, name: [*(F.col(f"c.{k}") == F.col(f"{name}.{k}") for k in keys), F.col(col_) == F.col(f"_p_{name}")]
    numbers = printed.select(*keys, F.col("printed").alias("_printed"), F.col(page).alias("_real"))
    rows = claims.alias("c").join(flag(sent, "sent").alias("sent"), on(f"c.{page}", "sent"), "left").join(flag(tampered, "bad").alias("bad"), on(f"c.{page}", "bad"), "left")
    rows = rows.join(numbers.alias("n"), [*(F.col(f"c.{k}") == F.col(f"n.{k}") for k in keys), F.col(f"c.{page}") == F.col("_printed")], "left")
    rows = rows.select("c.*", "_sent", "_bad", "_real")
    shown = sent.select(*keys, F.col(page).alias("_real"), F.lit(True).alias("_shown")).distinct()
    rows = rows.join(shown, [*keys, "_real"], "left")
    clean = F.col("_bad").isNull()
    tier = (
        F.when(F.coalesce(F.col(quoted), F.lit(False)) & clean, "text")
        .when(F.col("_sent") & clean, "rendered")
        .when(F.col("_shown"), "printed")
        .when((F.col("field") == "pins") & F.col("sole_page").isNotNull(), "pinout")
    )
    citation = F.when(tier.isin("text", "rendered"), F.col(page)).when(tier == "printed", F.col("_real")).when(tier == "pinout", F.col("sole_page"))
    confidence = F.when(tier == "text", 0.5).when(tier.isNotNull(), 0.4)
    return rows.withColumns({"tier": tier, "citation": citation, "confidence": confidence}).drop("_sent", "_bad", "_real", "_shown")
