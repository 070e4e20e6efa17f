"""Designators of packages and what they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entity as ops
from ..operators.packages import FAMILY
from .identity import code_sql
from .packages import variants_sql
from .registry import Registry, Tables

REGISTRY = Registry()
query = REGISTRY.query

#: Mentions and packages by arithmetic on keys; codes, names and lead counts repeat, so some mentions are ambiguous.
_MENTIONS = "SELECT p_partkey as m, case when p_partkey % 3 = 0 then 'C' || cast(p_partkey % 700 as string) end as code, 'FAM' || cast(p_partkey % 90 as string) || '-' || cast(p_size as string) as name, 'FAM' || cast(p_partkey % 90 as string) as family, p_size as leads FROM part"
_PACKAGES = "SELECT p_partkey as pkg, 'C' || cast(p_partkey % 650 as string) as code, 'fam' || cast(p_partkey % 90 as string) || ' ' || cast(p_size as string) as name, 'FAM' || cast(p_partkey % 90 as string) as family, p_size as leads FROM part"
_TIERS = ["code", "regexp_replace(upper(name), '[^A-Z0-9]', '', 'g')", "family || ':' || leads"]


def _from(t: Tables, sql: str) -> DataFrame:
    return t.spark.sql(sql.replace("FROM part", "FROM {p}"), p=t.part)


@query(
    f"WITH m AS ({_MENTIONS}), g AS ({_PACKAGES}), h AS ("
    + " UNION ALL ".join(f"SELECT m, {k} AS tier, count(DISTINCT pkg) AS n, min(pkg) AS pkg FROM (SELECT m, {e} AS x FROM m) JOIN (SELECT pkg, {e} AS x FROM g) USING (x) WHERE x IS NOT NULL GROUP BY m" for k, e in enumerate(_TIERS))
    + "), b AS (SELECT m, min(tier) FILTER (n = 1) AS tier, min(tier) FILTER (n > 1 AND tier = 0) AS veto, arg_min(pkg, tier) FILTER (n = 1) AS pkg FROM h GROUP BY m) SELECT m, pkg, tier FROM b WHERE tier IS NOT NULL AND (veto IS NULL OR veto > tier)"
)
def designator_ladder(t: Tables) -> DataFrame:
    """Mentions matched by code, else by folded name, else by family and leads; an ambiguous code ends the search."""
    fold = F.regexp_replace(F.upper("name"), "[^A-Z0-9]", "")
    pair = F.concat("family", F.lit(":"), "leads")
    return ops.ladder(_from(t, _MENTIONS), _from(t, _PACKAGES), "m", "pkg", [(F.col("code"), F.col("code")), (fold, fold), (pair, pair)], {0})


#: Designators and pin tables of two hundred documents, by arithmetic on keys: one form for each tier, and forms that name several tables or none.
_ASKED = """SELECT p_partkey % 200 as doc, p_partkey as m, case p_partkey % 8 when 0 then 'SOIC (D' || cast(p_size % 4 as string) || ')' when 1 then cast(4 + 2 * (p_size % 20) as string) || '-lead TSSOP' when 2 then 'RG' || cast(p_size % 3 as string) || ' (VQFN, 16)'
 when 3 then 'HVSSOP (DGN) [dgn000' || cast(p_size % 9 as string) || 'G] ' when 4 then cast(2 * p_size as string) || ' pin WQFN' when 5 then 'x2son' when 6 then 'Outline [MO-0' || cast(p_size % 5 as string) || ']' else '' end as designator FROM part"""
_TABLES = """SELECT p_partkey * 3 % 200 as doc, p_partkey as pkg, case p_partkey % 7 when 0 then array('SOIC-D' || cast(p_size % 4 as string), 'D') when 1 then array('TSSOP', 'PW' || cast(p_size as string)) when 2 then array('VQFN (RG' || cast(p_size % 3 as string) || ')')
 when 3 then array('HVSSOP (DGN)') when 4 then array('LQFP' || cast(p_size as string), null) when 5 then array('X2SON (DPW)') else array() end as names,
 case p_partkey % 3 when 0 then 'DGN000' || cast(p_size % 9 as string) || 'G' when 1 then 'dgn000' || cast(p_size % 9 as string) || 'g_A' else 'MO-0' || cast(p_size % 5 as string) || ' AB' end as outline, case when p_partkey % 2 = 0 then 2 * (p_size % 25) end as pins FROM part"""
_DUCK = lambda sql: sql.replace("as string)", "as varchar)").replace("array(", "list_value(")
_FOLDED = "nullif(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '')"
_HEAD_OF = "(starts_with({0}, {1}) AND ({0} = {1} OR substr({0}, length({1}) + 1, 1) IN (' ', '_', '-', '.')))"


def _family_code(rows: str) -> str:
    """id, family, code of the labels of rows (id, label)."""
    return f"SELECT id, nullif(upper(regexp_extract(label, '(?i)\\b(?:{FAMILY})\\b')), '') AS family, code FROM ({code_sql(rows)})"


@query(f"""WITH a AS (SELECT doc, m, nullif(upper(regexp_extract(trim(designator), '\\[([^\\]]+)\\]$', 1)), '') AS code, trim(regexp_replace(trim(designator), '\\[[^\\]]+\\]$', '')) AS label FROM ({_DUCK(_ASKED)})),
g AS ({_DUCK(_TABLES)}), n AS (SELECT row_number() OVER () AS id, doc, pkg, label FROM (SELECT doc, pkg, unnest(names) AS label FROM g)),
an AS (SELECT a.*, {_FOLDED.format('label')} AS name, family, c.code AS vendor FROM a JOIN ({_family_code('SELECT m AS id, label FROM a')}) c ON c.id = m), nn AS (SELECT n.*, {_FOLDED.format('label')} AS name, family, code AS vendor FROM n JOIN ({_family_code('SELECT id, label FROM n')}) USING (id)),
l AS (SELECT k AS m, any_value(leads) AS leads FROM ({variants_sql('SELECT m AS k, label AS t FROM a')}) v(k, nth, designator, family, leads, place) WHERE leads IS NOT NULL GROUP BY k HAVING count(*) = 1),
h AS (SELECT m, 0 AS tier, pkg FROM a JOIN g ON a.doc = g.doc AND ({_HEAD_OF.format('upper(outline)', 'code')} OR {_HEAD_OF.format('code', 'upper(outline)')})
UNION ALL SELECT m, 1, pkg FROM an JOIN nn ON an.doc = nn.doc AND an.name = nn.name UNION ALL SELECT m, 2, pkg FROM an JOIN nn ON an.doc = nn.doc AND (contains(an.name, nn.name) OR contains(nn.name, an.name))
UNION ALL SELECT m, 3, pkg FROM an JOIN nn ON an.doc = nn.doc AND an.family = nn.family AND an.vendor = nn.vendor WHERE an.name IS NOT NULL UNION ALL SELECT a.m, 4, pkg FROM a JOIN l USING (m) JOIN g ON a.doc = g.doc AND leads = pins),
c AS (SELECT m, tier, count(DISTINCT pkg) AS k, min(pkg) AS pkg FROM h GROUP BY m, tier), b AS (SELECT m, min(tier) FILTER (k = 1) AS tier, arg_min(pkg, tier) FILTER (k = 1) AS pkg, bool_or(k > 1 AND tier = 0) AS veto FROM c GROUP BY m)
SELECT m, pkg, tier FROM b WHERE tier IS NOT NULL AND NOT veto""")
def pin_tables_named(t: Tables) -> DataFrame:
    """Which pin table of its document each designator names, in five tiers."""
    return ops.pin_tables_named(_from(t, _ASKED), _from(t, _TABLES), "doc", "m", "pkg")


_ENTRY = """SELECT p_partkey, case p_partkey % 6 when 0 then 'DB, DGV, PW' when 1 then 'SOIC_W / TSSOP Packages' when 2 then 'TSSOP' when 3 then 'SOIC or plastic ' || cast(p_size as string) when 4 then 'VQFN; WSON package' end as label,
 case when p_partkey % 4 < 2 then p_retailprice end as d1, case when p_partkey % 3 = 0 then p_retailprice end as d2, p_size % 5 as n1, case when p_partkey % 5 = 0 then 5 else p_size % 5 end as n2 FROM part"""


@query(f"""SELECT p_partkey, len(list_filter(list_transform(string_split_regex(translate(coalesce(label, ''), '_', ' '), '[/;,]|\\s+or\\s+'), lambda x: trim(regexp_replace(trim(x), '(?i)\\s+Packages?$', ''))), lambda x: regexp_matches(x, '(?i)\\b(?:{FAMILY})\\b') OR regexp_matches(x, '^[A-Z]{{1,4}}[0-9]{{0,2}}$'))) > 1 AS several,
CASE WHEN d2 IS NOT NULL THEN 'second' WHEN d1 IS NOT NULL THEN 'first' END AS drawn, n1 = n2 AND p_partkey % 7 > 0 AS same_pins FROM ({_DUCK(_ENTRY)})""")
def joined_entries(t: Tables) -> DataFrame:
    """Of entries joined from two passes: whether their label is a set, whose name the drawing has, and whether their pins have the same names."""
    rows = _from(t, _ENTRY)
    dims = lambda d: F.when(F.col(d).isNotNull(), F.create_map(F.lit("pitch"), F.col(d))).otherwise(F.create_map().cast("map<string,double>"))
    pins = lambda n, last: F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.cast("string").alias("number"), F.when(i > 0, F.concat(F.lit("P"), i.cast("string"))).otherwise(last).alias("name")))
    other = F.when(F.col("p_partkey") % 7 == 0, "x")
    return rows.select(
        "p_partkey", ops.names_several(F.col("label")).alias("several"), ops.drawing_name(F.lit("first"), dims("d1"), F.lit("second"), dims("d2")).alias("drawn"),
        ops.same_pin_names(pins(F.col("n1"), F.lit(None)), pins(F.col("n2"), other)).alias("same_pins"),
    )


_FIRST = "SELECT p_partkey % 50 as doc, p_partkey as entry, case when p_partkey % 4 <> 0 then 'O' || cast(p_partkey % 400 as string) end as outline, 'F' || cast(p_partkey % 60 as string) as family, p_size as leads, case when p_partkey % 3 = 0 then p_retailprice end as pitch FROM part"
_SECOND = "SELECT p_partkey % 50 as doc, p_partkey + 1000000 as entry, case when p_partkey % 5 <> 0 then 'O' || cast(p_partkey % 420 as string) end as outline, 'F' || cast(p_partkey % 60 as string) as family, p_size as leads, p_retailprice + 1 as pitch FROM part"


@query(f"""WITH a AS ({_FIRST}), b AS ({_SECOND}), p AS (SELECT DISTINCT a.doc, a.entry AS ae, b.entry AS be FROM a JOIN b ON a.doc = b.doc AND (a.outline = b.outline OR a.family = b.family)
 WHERE coalesce(a.outline = b.outline, true) AND coalesce(a.leads = b.leads, true)), s AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc, ae) AS na, count(*) OVER (PARTITION BY doc, be) AS nb FROM p) WHERE na = 1 AND nb = 1)
SELECT a.doc, a.entry, s.be AS merged, coalesce(a.outline, b.outline) AS outline, coalesce(a.pitch, b.pitch) AS pitch FROM a LEFT JOIN s ON a.doc = s.doc AND a.entry = s.ae LEFT JOIN b ON b.doc = s.doc AND b.entry = s.be
UNION ALL SELECT doc, entry, NULL, outline, pitch FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc = b.doc AND s.be = b.entry)""")
def entry_merge(t: Tables) -> DataFrame:
    """Package entries of two passes as one list."""
    return ops.merge_entries(_from(t, _FIRST), _from(t, _SECOND), "doc", ["outline", "family"], ["outline", "leads"], ["outline", "pitch"])


_CAPTIONS = "SELECT p_partkey % 80 as doc, p_partkey as caption_id, case when p_partkey % 5 = 0 then 'x' || cast(p_partkey % 37 as string) || ' / X' || cast(p_size % 11 as string) || ' or x' || cast(p_partkey % 13 as string) end as caption, p_size % 6 as leads FROM part"
_ENTRIES = "SELECT p_partkey % 80 as doc, p_partkey as entry, 'X' || cast(p_partkey % 37 as string) as code, p_size % 6 as leads FROM part"


@query(f"""WITH n AS (SELECT DISTINCT doc, caption_id, leads, upper(trim(unnest(string_split_regex(caption, '[/;,]| or ')))) AS name FROM ({_CAPTIONS})),
h AS (SELECT n.doc, caption_id, name, entry FROM n JOIN ({_ENTRIES}) e ON n.doc = e.doc AND n.name = upper(e.code) AND n.leads = e.leads WHERE name <> '')
SELECT DISTINCT doc, caption_id, entry FROM (SELECT *, count(*) OVER (PARTITION BY doc, caption_id, name) AS k FROM h) WHERE k = 1""")
def caption_broadcast(t: Tables) -> DataFrame:
    return ops.caption_broadcast(_from(t, _CAPTIONS), _from(t, _ENTRIES), "doc", "caption", "leads", "code")
