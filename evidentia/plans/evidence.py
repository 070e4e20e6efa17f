"""Claims against documents. Claims are the benchmark's passages; pages are groups of twelve lines of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as ops
from ..sources import tables as S
from .registry import Registry, Tables
from .text import PAGES_SQL

REGISTRY = Registry()
query = REGISTRY.query

_WORDS = "trim(regexp_replace({0}, '[ \t\r\n]+', ' ', 'g'))"
CITED_SQL = f"""SELECT doc_id, page, item_id FROM (SELECT *, ' ' || {_WORDS.format("page_text")} || ' ' AS t FROM ({PAGES_SQL})), (SELECT item_id, ' ' || {_WORDS.format("text")} || ' ' AS v FROM benchmark WHERE {_WORDS.format("text")} <> '') WHERE contains(t, v)"""


def pages(t: Tables) -> DataFrame:
    return S.pages(t.documents).withColumn("page", F.col("page").cast("long"))


def cited(t: Tables) -> DataFrame:
    return ops.cited(t.benchmark, pages(t), "item_id", "text", ["doc_id", "page"], "page_text")


@query(CITED_SQL)
def citation_contains(t: Tables) -> DataFrame:
    return cited(t)


_NAMES = f"SELECT DISTINCT doc_id, item_id, unnest(string_split({_WORDS.format('b.text')}, ' ')) AS name FROM (SELECT DISTINCT doc_id, item_id FROM ({CITED_SQL})) JOIN benchmark b USING (item_id)"
RATIO_SQL = f"""WITH n AS (SELECT * FROM ({_NAMES}) WHERE length(name) >= 2), k AS (SELECT doc_id, item_id, count(*) AS names FROM n GROUP BY ALL),
w AS (SELECT DISTINCT doc_id, page, unnest(string_split({_WORDS.format('page_text')}, ' ')) AS name FROM ({PAGES_SQL}) WHERE doc_id IN (SELECT doc_id FROM k))
SELECT doc_id, item_id, page, count(*) AS found, any_value(names) AS names, count(*) / any_value(names) AS ratio FROM w JOIN n USING (doc_id, name) JOIN k USING (doc_id, item_id) GROUP BY doc_id, item_id, page"""


def ratios(t: Tables) -> DataFrame:
    """For every document and each passage it quotes: the share of the passage's words on each page."""
    pairs = cited(t).select("doc_id", "item_id").distinct()
    names = pairs.join(t.benchmark, "item_id").select("doc_id", "item_id", F.explode(F.split(F.trim(F.regexp_replace("text", "[ \t\r\n]+", " ")), " ")).alias("name"))
    paged = pages(t).join(pairs, "doc_id")
    return ops.match_ratio(names, paged, ["doc_id", "item_id"], "page", "name", "page_text")


@query(f"SELECT doc_id, item_id, min(page) AS page FROM ({RATIO_SQL}) WHERE ratio >= 0.6e0 GROUP BY ALL")
def pin_ratio_page(t: Tables) -> DataFrame:
    """The first page with three fifths of a passage's words."""
    return ratios(t).where("ratio >= 0.6e0").groupBy("doc_id", "item_id").agg(F.min("page").alias("page"))


@query(f"""SELECT doc_id, item_id, page, found, names FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id) AS ties FROM (SELECT *, rank() OVER (PARTITION BY doc_id, item_id ORDER BY found DESC) AS r FROM ({RATIO_SQL})) WHERE r = 1)
WHERE ties = 1 AND 2 * found > names""")
def unique_page_vote(t: Tables) -> DataFrame:
    return ops.sole_page(ratios(t), ["doc_id", "item_id"], "page", "found", "names").select("doc_id", "item_id", "page", "found", "names")


#: A record's fields by order, and what two passes of a model claim: some values are missing, some uncited, some drawn.
_FIELDS = "FROM orders CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS v(f)"
_BASE = f"SELECT o_orderkey as k, f, case when (o_custkey + f) % 3 = 0 then o_custkey + f end as value {_FIELDS} WHERE (o_orderkey + f) % 7 <> 0"
_CLAIMS = f"SELECT o_orderkey as k, f, case when (o_custkey + 2 * f) % 5 = 0 then null else o_custkey * 10 + f end as value, case when (o_orderkey + f) % 3 = 0 then cast(1 + o_custkey % 9 as int) end as citation, (o_custkey + f) % 4 = 0 as drawn {_FIELDS} WHERE (o_orderkey + 3 * f) % 11 <> 0"
MERGED_SQL = f"""SELECT k, f, coalesce(b.value, c.value) AS value, CASE WHEN b.value IS NOT NULL THEN 1.0e0 WHEN c.value IS NULL THEN NULL WHEN c.citation IS NOT NULL THEN 0.5e0 WHEN c.drawn THEN 0.4e0 END AS confidence,
CASE WHEN b.value IS NOT NULL THEN 'deterministic' WHEN c.value IS NULL THEN NULL WHEN c.citation IS NULL AND c.drawn THEN 'vlm-drawing' ELSE 'vlm' END AS method, CASE WHEN b.value IS NULL AND c.value IS NOT NULL THEN c.citation END AS citation
FROM ({_BASE}) b FULL OUTER JOIN ({_CLAIMS}) c USING (k, f)"""


def merged(t: Tables) -> DataFrame:
    base, claims = (t.spark.sql(q.replace("FROM orders", "FROM {o}"), o=t.orders) for q in (_BASE, _CLAIMS))
    return ops.merged(base, claims, ["k", "f"])


@query(MERGED_SQL)
def merge_precedence(t: Tables) -> DataFrame:
    return merged(t)


@query(f"""SELECT k, coalesce(string_agg(f::VARCHAR, ',' ORDER BY f) FILTER (value IS NULL AND f <= 3), '') AS missing, coalesce(string_agg(f::VARCHAR, ',' ORDER BY f) FILTER (value IS NOT NULL AND method LIKE 'vlm%' AND citation IS NULL), '') AS untraceable,
count(*) FILTER ((value IS NULL AND f <= 3) OR (value IS NOT NULL AND method LIKE 'vlm%' AND citation IS NULL)) = 0 AS ok FROM ({MERGED_SQL}) GROUP BY k""")
def untraceable_gate(t: Tables) -> DataFrame:
    rows = merged(t).withColumn("f", F.col("f").cast("string"))
    out = ops.resolved(rows, "k", "f", ["1", "2", "3"])
    return out.select("k", F.array_join("missing", ",").alias("missing"), F.array_join("untraceable", ",").alias("untraceable"), "ok")


@query("""SELECT doc_id, v[1] AS stated FROM (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '([0-9]{1,3}[.][0-9]{1,3})[.]', 1), lambda x: try_cast(x AS DOUBLE)), lambda x: x > 0 AND x <= 200)) AS v FROM documents) WHERE len(v) = 1""")
def stated_maximum(t: Tables) -> DataFrame:
    """Texts that state one plausible number of a form, and only one."""
    return t.documents.select("doc_id", ops.stated_maximum(F.col("text"), "([0-9]{1,3}[.][0-9]{1,3})[.]", 200.0).alias("stated")).where("stated is not null")


_LADDER = "SELECT o_orderkey as k, case f when 1 then 'pins' when 2 then 'pitch' else 'span' end as field, cast(1 + (o_custkey * f) % 9 as int) as page, case when (o_custkey + f) % 7 = 0 then null else (o_custkey + f) % 4 = 0 end as quoted, case when o_custkey % 3 = 0 then cast(2 as int) end as sole_page FROM orders CROSS JOIN (VALUES (1), (2), (3)) AS v(f)"
_SENT = "SELECT o_orderkey as k, cast(p as int) as page FROM orders CROSS JOIN (VALUES (1), (3), (4), (8)) AS v(p)"
_BAD = "SELECT o_orderkey as k, cast(case when o_custkey % 2 = 0 then 3 else 7 end as int) as page FROM orders"
_FEET = "SELECT o_orderkey as k, cast(p as int) as printed, cast(p + 2 as int) as page FROM orders CROSS JOIN (VALUES (2), (5), (6)) AS v(p)"


@query(f"""WITH c AS (SELECT l.*, s.page IS NOT NULL AS sent, b.page IS NULL AS clean, n.page AS real_, r.page IS NOT NULL AS shown FROM ({_LADDER}) l LEFT JOIN ({_SENT}) s ON s.k = l.k AND s.page = l.page LEFT JOIN ({_BAD}) b ON b.k = l.k AND b.page = l.page
LEFT JOIN ({_FEET}) n ON n.k = l.k AND n.printed = l.page LEFT JOIN ({_SENT}) r ON r.k = l.k AND r.page = n.page), t AS (SELECT *, CASE WHEN coalesce(quoted, false) AND clean THEN 'text' WHEN sent AND clean THEN 'rendered' WHEN shown THEN 'printed' WHEN field = 'pins' AND sole_page IS NOT NULL THEN 'pinout' END AS tier FROM c)
SELECT k, field, tier, CASE WHEN tier IN ('text', 'rendered') THEN page WHEN tier = 'printed' THEN real_ WHEN tier = 'pinout' THEN sole_page END AS citation, CASE WHEN tier = 'text' THEN 0.5e0 WHEN tier IS NOT NULL THEN 0.4e0 END AS confidence FROM t""")
def citation_ladder(t: Tables) -> DataFrame:
    """Where three claims of every order can be shown: quoted, rendered, by the printed page number, or on the pinout page."""
    made = [t.spark.sql(q.replace("FROM orders", "FROM {o}"), o=t.orders) for q in (_LADDER, _SENT, _BAD, _FEET)]
    return ops.located(*made, ["k"], "quoted", "page").select("k", "field", "tier", "citation", "confidence")
