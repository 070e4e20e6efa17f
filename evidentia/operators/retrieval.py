"""Finding and ranking candidate sources: links of pages, candidates for parts, fallback chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, ord: distinct http(s) links of each page in order of first occurrence; redirect parameters unwrapped, rooted paths resolved."""
    found = pages.select(key, F.regexp_extract(url, "^(https?://[^/?#]+)", 1).alias("base"), F.posexplode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "raw"))
    raw = F.replace("raw", F.lit("&amp;"), F.lit("&"))
    inner = F.regexp_extract(raw, "[?&](?:uddg|u)=(https?[^&#]*)", 1)
    raw = F.when(inner != "", F.try_url_decode(inner)).otherwise(raw)
    absolute = (
        F.when(F.startswith(raw, F.lit("//")), F.concat(F.lit("https:"), raw))
        .when(F.startswith(raw, F.lit("/")) & (F.col("base") != ""), F.concat("base", raw))
        .otherwise(raw)
    )
    return found.select(key, absolute.alias("url"), "ord").where(F.col("url").rlike("^https?://")).groupBy(key, "url").agg(F.min("ord").alias("ord"))


def document_links(found: DataFrame, key: str = "page_id", most: int = 8) -> DataFrame:
    """The first `most` links of each page that lead to PDF documents."""
    pdf = F.lower("url").rlike("[.]pdf([?#]|$)") | F.lower("url").rlike("download.*pdf")
    nth = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    return found.where(pdf).withColumn("nth", nth).where(F.col("nth") <= most)


def top_ranked(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key, numbered from 1 in column rank (the window's limit is applied before the shuffle)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def candidate_score(url: Column, names: Column, hosts: list[str], aggregators: list[str], maker: Column | None = None) -> Column:
    """Points of a candidate: a PDF 100, the part's name 20, a trusted host 12, the maker 8, an aggregator -30."""
    low = F.lower(url)
    any_of = lambda options: F.lit(False) if not options else _any(low, options)
    named = F.exists(names, lambda n: F.contains(low, F.lower(n)))
    score = F.when(low.rlike("[.]pdf([?#]|$)"), 100).otherwise(0) + F.when(named, 20).otherwise(0)
    score = score + F.when(any_of(hosts), 12).otherwise(0) - F.when(any_of(aggregators), 30).otherwise(0)
    return score if maker is None else score + F.when(F.contains(low, T.slug(maker)), 8).otherwise(0)


def _any(text: Column, options: list[str]) -> Column:
    out = F.contains(text, F.lit(options[0]))
    for o in options[1:]:
        out = out | F.contains(text, F.lit(o))
    return out


def candidate_urls(parts: DataFrame, vendors: DataFrame, key: str, part: str) -> DataFrame:
    """key, vendor, url, claimed, ord: every variant of every part at every one of the vendors (vendor, prefix, template), however many.

    Claimed candidates, of vendors whose prefix the part has, come before speculative ones.
    """
    variants = parts.select(key, part, F.posexplode(T.part_variants(F.col(part))).alias("nth", "variant"))
    both = variants.crossJoin(vendors)
    claimed = F.rlike(T.normalised_part(F.col(part)), F.concat(F.lit("^("), F.col("prefix"), F.lit(")")))
    return both.select(key, "vendor", F.replace("template", F.lit("{part}"), F.lower("variant")).alias("url"), claimed.alias("claimed"), "nth")


def first_hit(attempts: DataFrame, keys: list[str], rank: str, outcome: str, value: str) -> DataFrame:
    """Ordered fallback: the first hit by rank wins; else `failed` if an attempt failed hard, else `miss`.

    outcome is hit, miss, soft or hard. One aggregation: no join, no sort.
    """
    hit = F.col(outcome) == "hit"
    return attempts.groupBy(*keys).agg(
        F.min_by(F.when(hit, F.col(value)), F.when(hit, F.col(rank))).alias(value),
        F.min(F.when(hit, F.col(rank))).alias("resolved_by"),
        F.when(F.count_if(hit) > 0, "ok").when(F.count_if(F.col(outcome) == "hard") > 0, "failed").otherwise("miss").alias("status"),
    )


def orphans(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of left that right doesn't know."""
    return left.join(right.select(on).distinct(), on, "left_anti")


#: Links that are followed from one page, and results of one search that are looked at.
MOST_LINKS, MOST_RESULTS = 8, 12


def _is_pdf(content_type: Column, url: Column) -> Column:
    return F.coalesce(F.contains(F.lower(content_type), F.lit("pdf")), F.lit(False)) | F.coalesce(url.rlike(r"(?i)\.pdf(\?|#|$)"), F.lit(False))


def inspected(candidates: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """keys, url, pdf_url, source_url: what each candidate comes to, null where it is unusable.

    responses: url, status, content_type, final_url, html, what was fetched before; an address that may not be fetched,
    has no response or failed is unusable and ends nothing. A document stands for itself; of a page the first of its
    MOST_LINKS document links that leads to a document counts.
    """
    fetched = responses.where(F.col("status").between(200, 299) & (T.url_verdict(F.col("url")) == "ok"))
    fetched = fetched.select("url", F.coalesce("final_url", "url").alias("final_url"), "content_type", "html").withColumn("pdf", _is_pdf(F.col("content_type"), F.col("final_url")))
    pages = fetched.where(~F.col("pdf") & F.contains(F.lower("content_type"), F.lit("html")))
    out = document_links(links(pages.select("url", "final_url", "html").withColumnRenamed("url", "page"), "page", "final_url", "html"), "page", MOST_LINKS)
    led = out.join(fetched.where("pdf").select("url", F.col("final_url").alias("_to")), "url").groupBy("page").agg(F.min_by("_to", "nth").alias("led_to"))
    known = fetched.join(led.withColumnRenamed("page", "url"), "url", "left")
    pdf = F.when(F.col("pdf"), F.col("final_url")).otherwise(F.col("led_to"))
    known = known.select("url", pdf.alias("pdf_url"), F.when(F.col("pdf"), F.col("url")).when(F.col("led_to").isNotNull(), F.col("final_url")).alias("source_url"))
    return candidates.select(*keys, "url").join(known, "url", "left").select(*keys, "url", "pdf_url", "source_url")


def located(candidates: DataFrame, searches: DataFrame, key: str) -> DataFrame:
    """key, pdf_url, source_url, search_blocked: the first usable candidate, those that need no search first, then the searches in order.

    candidates: key, tier (0 without a search, else the search's number), rank, pdf_url, source_url; of a search the
    first MOST_RESULTS are looked at. searches: key, tier, blocked. The first search that every backend refuses ends
    the lookup: what comes after isn't tried, and a lookup that ends so hasn't shown that there is no document.
    """
    ended = searches.where("blocked").groupBy(key).agg(F.min("tier").alias("_ended"))
    usable = candidates.where(F.col("pdf_url").isNotNull() & ((F.col("tier") == 0) | (F.col("rank") <= MOST_RESULTS)))
    usable = usable.join(ended, key, "left").where(F.col("_ended").isNull() | (F.col("tier") < F.col("_ended")))
    best = usable.groupBy(key).agg(F.min_by(F.struct("pdf_url", "source_url"), F.struct("tier", "rank")).alias("b"))
    asked = candidates.select(key).union(searches.select(key)).distinct()
    rows = asked.join(best, key, "left").join(ended, key, "left")
    return rows.select(key, "b.pdf_url", "b.source_url", (F.col("b").isNull() & F.col("_ended").isNotNull()).alias("search_blocked"))
