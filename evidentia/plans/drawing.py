"""Pages of drawings, made of part keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drawing as ops
from ..operators.packages import FAMILY
from ..sources import tables as S
from .registry import Registry, Tables
from .text import LINES_SQL, PAGES_SQL

REGISTRY = Registry()
query = REGISTRY.query
c = F.col


def _derive(t: Tables, sql: str, name: str) -> DataFrame:
    return t.spark.sql(sql.replace(f"FROM {name}", "FROM {x}"), x=getattr(t, name))


def _duck(sql: str) -> str:
    return sql.replace("as string)", "as varchar)")


_SPANS = f"SELECT doc_id, line_no // 12 + 1 AS page, min(start) AS start, max(start + length(line)) + 1 AS end_ FROM ({LINES_SQL}) GROUP BY doc_id, line_no // 12"


def _spans(t: Tables) -> DataFrame:
    """Pages of documents with where they begin and end in the text."""
    size = F.length("page_text") + 1
    from pyspark.sql import Window

    upto = F.sum(size).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return S.pages(t.documents).select("doc_id", c("page").cast("long").alias("page"), (upto - size).alias("start"), upto.alias("end"))


@query(f"""SELECT d.doc_id, o.off AS "offset", (SELECT min(page) FROM ({_SPANS}) s WHERE s.doc_id = d.doc_id AND s.end_ > o.off) AS page FROM documents d, (VALUES (0::BIGINT), (700), (2500), (1000000)) AS o(off)""")
def offset_pages(t: Tables) -> DataFrame:
    """The page that each of four places of every text is on."""
    offsets = t.documents.select("doc_id", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 700, 2500, 1_000_000)))).alias("offset"))
    return ops.on_page(offsets, _spans(t), "doc_id", "offset")


@query(f"SELECT doc_id, coalesce(min(CASE WHEN page = 4 THEN start END), max(end_))::BIGINT AS front_end FROM ({_SPANS}) GROUP BY doc_id")
def front_matter(t: Tables) -> DataFrame:
    return ops.front_matter_end(_spans(t), "doc_id")


_LAND = r"""case p_partkey % 6 when 0 then 'EXAMPLE BOARD LAYOUT' || chr(10) || 'D0008A SOIC' || chr(10) || '8X (1.5) (0.05) 6X (' || cast(p_size as string) || '.25)' || chr(10) || 'LAND PATTERN EXAMPLE' when 1 then 'EXAMPLE BOARD LAYOUT' || chr(10) || 'PW0008A TSSOP' || chr(10) || '(9.9) LAND PATTERN EXAMPLE then EXAMPLE BOARD LAYOUT' || chr(10) || 'D0014A SOIC' || chr(10) || '(2.5) Land pattern example'
 when 2 then 'no title, an SOIC with (3.' || cast(p_size as string) || ') LAND PATTERN EXAMPLE' when 3 then '(4.4) LAND PATTERN EXAMPLE' when 4 then 'nothing' else null end"""
_HEAD = r"'(?i)^EXAMPLE BOARD LAYOUT\s*\n\s*\S+\s+([A-Z0-9-]+)'"


@query(rf"""WITH d AS (SELECT p_partkey, {_duck(_LAND)} AS t FROM part), o AS (SELECT p_partkey, t, unnest(range(1, len(string_split(upper(t), 'LAND PATTERN EXAMPLE')))) AS i FROM d), p AS (SELECT p_partkey, t, list_sum(list_transform(string_split(upper(t), 'LAND PATTERN EXAMPLE')[1:i], lambda x: length(x)))::BIGINT + (i - 1) * 20 AS place FROM o),
w AS (SELECT p_partkey, place, substr(t, greatest(0, place - 1200) + 1, place - greatest(0, place - 1200) + 80) AS w FROM p), b AS (SELECT p_partkey, place, CASE WHEN contains(upper(w), 'EXAMPLE BOARD LAYOUT') THEN 'EXAMPLE BOARD LAYOUT' || right(w, length(string_split(upper(w), 'EXAMPLE BOARD LAYOUT')[-1])) ELSE w END AS b FROM w),
v AS (SELECT p_partkey, place, list_filter(list_transform(regexp_extract_all(b, '{ops.CALLOUT}', 2), lambda x: x::DOUBLE), lambda x: x > 0.1 AND x <= 100) AS vals FROM b WHERE CASE WHEN regexp_extract(b, {_HEAD}, 1) <> '' THEN upper(regexp_extract(b, {_HEAD}, 1)) = 'SOIC' ELSE regexp_matches(upper(b), '\bSOIC\b') END)
SELECT p_partkey, min(place) AS place, arg_min(list_sum(vals), place) AS total, arg_min(len(vals), place) AS n FROM v WHERE len(vals) > 0 GROUP BY p_partkey""")
def vendor_land_scan(t: Tables) -> DataFrame:
    """Printed land patterns of an SOIC: right drawings, others' drawings, drawings without a title."""
    found = ops.land_patterns(t.part.selectExpr("p_partkey", f"{_LAND} as text", "'soic narrow' as family"), "p_partkey", "text", "family")
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v["mm"])
    return found.select("p_partkey", "place", total.alias("total"), F.size("values").cast("long").alias("n"))


_FIGURE = "case p_partkey % 5 when 0 then 'Figure 4. LQFP-' || cast(p_size as string) || ' - Footprint example and more' when 1 then 'LQFP64 footprint example ........ 48 ' || 'Figure 9. LQFP 64 footprint example' when 2 then 'Figure 2. TSSOP - footprint example' when 3 then '' else null end"


@query(rf"""WITH d AS (SELECT p_partkey, {_duck(_FIGURE)} AS t FROM part), o AS (SELECT p_partkey, t, unnest(range(1, len(string_split(lower(t), 'footprint example')))) AS i FROM d), p AS (SELECT p_partkey, t, list_sum(list_transform(string_split(lower(t), 'footprint example')[1:i], lambda x: length(x)))::BIGINT + (i - 1) * 17 AS place FROM o)
SELECT p_partkey, min(place) AS place FROM p WHERE NOT regexp_matches(substr(t, place + 1, 80), '\.{{4,}}|(?:\.\s){{4,}}') AND contains(regexp_replace(upper(substr(t, greatest(0, place - 60) + 1, least(place, 60))), '[^A-Z0-9]', '', 'g'), 'LQFP') GROUP BY p_partkey""")
def unreadable_footprints(t: Tables) -> DataFrame:
    return ops.unreadable_footprints(t.part.selectExpr("p_partkey", f"{_FIGURE} as text", "'LQFP' as family"), "p_partkey", "text", "family")


_OUTLINE = "case p_partkey % 6 when 0 then 'PACKAGE OUTLINE DW' || lpad(cast(p_size as string), 4, '0') || 'A wide' when 1 then 'Mechanical  data, much further on than forty characters: D0008A' when 2 then 'package drawing PW9999A' when 3 then 'SOT-23 D0008A' when 4 then '' else null end"


@query(rf"""SELECT p_partkey, CASE WHEN leads BETWEEN 2 AND 2000 THEN code END AS code, CASE WHEN leads BETWEEN 2 AND 2000 THEN leads END AS leads, coalesce(regexp_matches(upper(t), '\bSOT[\s-]?23\b'), false) AS named, nullif(upper(regexp_extract(t, '(?i)\b({FAMILY})\b', 1)), '') AS family
FROM (SELECT *, try_cast(regexp_extract(code, '([0-9]{{4}})', 1) AS INTEGER) AS leads FROM (SELECT p_partkey, t, regexp_extract(regexp_extract(t, '(?is)((?:{ops.DRAWING_HEADING}).{{0,40}})', 1), '\b([A-Z]{{1,4}}[0-9]{{4}}[A-Z])\b', 1) AS code FROM (SELECT p_partkey, {_duck(_OUTLINE)} AS t FROM part)))""")
def drawing_codes(t: Tables) -> DataFrame:
    rows = t.part.selectExpr("p_partkey", f"{_OUTLINE} as text").withColumn("d", ops.drawing_code(c("text")))
    return rows.select("p_partkey", "d.code", "d.leads", F.coalesce(ops.names_family(c("text"), F.lit("sot23")), F.lit(False)).alias("named"), ops.family_token(c("text")).alias("family"))


_DRAWN = "SELECT l_orderkey as doc, l_linenumber as page, case when l_partkey % 3 = 0 then 'see page' else 'Package outline ' || case when l_suppkey % 2 = 0 then 'LQFP 64' else 'SOIC' end end as text FROM lineitem"
_ITEMS = "SELECT l_orderkey as doc, l_linenumber as page, cast(k * (1 + l_suppkey % 9) as double) as x, case when k % 7 = 0 then 'mm' else cast(k as string) end as str FROM lineitem CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (8), (9), (10), (11), (12), (14), (15)) AS v(k) WHERE k <= 4 + l_partkey % 12"


@query(rf"""WITH i AS (SELECT doc, page, count(*) AS values_, count(DISTINCT round(x / 6)) AS cols FROM ({_duck(_ITEMS)}) WHERE regexp_matches(trim(str), '^\(?[0-9]{{1,3}}(?:\.[0-9]{{1,3}})?\)?$') GROUP BY ALL), r AS (SELECT doc, page, values_, regexp_matches(upper(text), '\bLQFP[\s-]?64\b') AS named FROM ({_duck(_DRAWN)}) JOIN i USING (doc, page) WHERE regexp_matches(text, '(?i){ops.DRAWING_HEADING}') AND values_ >= 8 AND cols / values_ >= 0.3e0)
SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY named DESC, values_ DESC, page) AS rank, values_ AS "values", named AS names_package FROM r QUALIFY rank <= 5""")
def drawing_ranks(t: Tables) -> DataFrame:
    """Pages that are drawings, the one of the wanted package first."""
    pages = _derive(t, _DRAWN, "lineitem").withColumn("family", F.lit("LQFP64"))
    return ops.ranked_drawings(pages, _derive(t, _ITEMS, "lineitem"), "doc", "page", "family").withColumn("rank", c("rank").cast("long"))


_NAMED = "SELECT l_orderkey as doc, 'P' || cast(l_partkey % 5 as string) as designator, l_suppkey % 3 = 0 as front, l_linenumber as place FROM lineitem"


@query(f"""WITH f AS (SELECT doc, designator, min((NOT front)::INTEGER * 100 + place) AS o FROM ({_duck(_NAMED)}) GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY o, designator) AS k FROM f) SELECT doc, string_agg(designator, ',' ORDER BY k) AS candidates FROM n WHERE k <= 8 GROUP BY doc HAVING count(*) > 1""")
def candidate_designators(t: Tables) -> DataFrame:
    found = ops.candidate_designators(_derive(t, _NAMED, "lineitem"), "doc", "designator", "front", "place")
    return found.select("doc", F.array_join("candidates", ",").alias("candidates"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_size, 3, p_size % 7, 99, 3, NULL], lambda x: x BETWEEN 1 AND 40)))[1:16], ',') AS pages FROM part")
def page_requests(t: Tables) -> DataFrame:
    asked = F.array(c("p_size"), F.lit(3), c("p_size") % 7, F.lit(99), F.lit(3), F.lit(None).cast("int"))
    return t.part.select("p_partkey", F.array_join(ops.pages_to_render(asked, F.sequence(F.lit(1), F.lit(40))), ",").alias("pages"))
