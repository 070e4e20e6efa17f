"""Package names in texts, drawing codes, and answers of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..operators import packages as ops
from .registry import Registry, Tables

REGISTRY = Registry()
query = REGISTRY.query

#: Lines made of keys, for either engine: each form, each trap.
_TEXT = """case p_partkey % 9 when 0 then 'Comes as ' || cast(4 + 2 * (p_size % 20) as string) || '-lead HTSSOP, or ' || cast(4 + 2 * (p_size % 20) as string) || ' pin HTSSOP' when 1 then 'MSOP (' || cast(p_size as string) || '), rev(2)'
 when 2 then 'one PQFP-' || cast(p_size * 2 as string) || 'X of many' when 3 then 'SO' || cast(p_size as string) || ', hermetic SO' || cast(p_size as string) || ' or TO92' when 4 then cast(p_size * 10 as string) || ' CDIP tubes, 33 LGA'
 when 5 then 'SC1 SC2 SC3 channels' when 6 then 'going to 8 pins TSSOP to 9' when 7 then 'SOD-' || cast(p_size as string) || ' and ' || cast(p_size as string) || ' ld EP-VQFN' else '' end"""
_FORM_ROWS = " UNION ALL ".join(
    f"SELECT k, t, {n} AS form, '{f}' AS f, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS ms FROM lines"
    for n, (f, p) in enumerate(ops.FORMS.items())
)
_IN = lambda names: ", ".join(f"'{n}'" for n in names)


def variants_sql(lines: str) -> str:
    """p_partkey, nth, designator, family, leads, place of the lines (k, t)."""
    return rf"""WITH lines AS ({lines}), f0 AS ({_FORM_ROWS}),
f1 AS (SELECT k, t, form, f, m, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS place FROM f0),
f2 AS (SELECT k, t, form, f, CASE WHEN c THEN substr(m, 2) ELSE m END AS m, place + CASE WHEN c THEN 1 ELSE 0 END AS place FROM (SELECT *, f = 'alone' AND NOT regexp_matches(m, '^[0-9]') AS c FROM f1)),
f3 AS (SELECT *, regexp_extract(m, '{ops.FIRST}', 1) || regexp_extract(m, '{ops.LAST}', 1) AS printed, try_cast(regexp_extract(regexp_replace(m, '{ops.FIRST}', ''), '([0-9]{{1,3}})', 1) AS INTEGER) AS number FROM f2),
f4 AS (SELECT *, upper(printed) AS family, CASE WHEN upper(printed) NOT IN ({_IN(ops.OUTLINE_NUMBERED)}) THEN number END AS leads FROM f3),
f5 AS (SELECT k, form, f, family, leads, place, regexp_replace(m, '\s+', ' ', 'g') AS name, regexp_extract(substr(t, greatest(1, place + 1 - {ops.FRONT})::BIGINT, least(place, {ops.FRONT})::BIGINT), '{ops.MATERIAL}', 1) AS material FROM f4
 WHERE (family NOT IN ({_IN(ops.CAPITALS_ONLY)}) OR printed = family) AND NOT (f = 'keyword' AND regexp_matches(regexp_extract(m, '{ops.BETWEEN}', 1), '{ops.IS_FAMILY}'))
 AND CASE WHEN leads IS NULL THEN f <> 'alone' ELSE leads BETWEEN CASE WHEN f = 'glued' THEN {ops.LEAST_GLUED} ELSE 2 END AND {ops.MOST_LEADS} AND (f <> 'alone' OR (leads % 2 = 0 AND leads BETWEEN 4 AND 400)) END),
f6 AS (SELECT *, row_number() OVER (e ORDER BY material = '', form, place) AS r, bool_or(f = 'glued' AND leads IS NULL) OVER (e) AS glued FROM f5 WINDOW e AS (PARTITION BY k, family, coalesce(leads::VARCHAR, upper(name)))),
f7 AS (SELECT *, sum(glued::INTEGER) OVER (PARTITION BY k, family) AS many FROM f6 WHERE r = 1)
SELECT k AS p_partkey, row_number() OVER (PARTITION BY k ORDER BY place) - 1 AS nth, CASE WHEN material = '' THEN name ELSE material || ' ' || name END AS designator, family, leads::BIGINT AS leads, place::BIGINT AS place FROM f7 WHERE NOT glued OR many < 2"""


@query(variants_sql(f"SELECT p_partkey AS k, {_TEXT} AS t FROM part"))
def package_variants(t: Tables) -> DataFrame:
    """Packages that made-up lines name."""
    return ops.package_variants(t.part.selectExpr("p_partkey", f"{_TEXT} as text"), "p_partkey", "text")


_CODES = "SELECT p_partkey, case p_partkey % 5 when 0 then 'CASE 75' || cast(p_size % 7 as string) || '-07' when 1 then ' dw' || cast(1000 + p_size % 9 as string) || 'a (R-PDSO) ' when 2 then '1L_LQFP100' when 3 then '' else 'MS-012 AA' end as a, case p_partkey % 4 when 0 then '75' || cast(p_size % 5 as string) || '-07' when 1 then 'DW' || cast(1000 + p_size % 9 as string) || 'A' when 2 then '1l' else null end as b FROM part"
_CODE_SQL = r"CASE WHEN length({0}_) BETWEEN 1 AND 32 THEN {0}_ END"
_BARE_SQL = r"upper(trim(regexp_replace(regexp_replace(regexp_replace(trim({0}), '(?i)^(CASE|PACKAGE\s+OUTLINE|OUTLINE)\s+', ''), '\s*\([^)]*\)\s*', ' ', 'g'), '\s+', ' ', 'g')))"


@query(rf"""WITH c AS (SELECT p_partkey, b AS raw_b, {_BARE_SQL.format('a')} AS a_, {_BARE_SQL.format('b')} AS b_ FROM ({_CODES})), d AS (SELECT p_partkey, raw_b, {_CODE_SQL.format('a')} AS a, {_CODE_SQL.format('b')} AS b FROM c),
e AS (SELECT *, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM d)
SELECT p_partkey, a AS code, a = b OR (starts_with(l, s) AND substr(l, length(s) + 1, 1) IN (' ', '_', '-', '.')) AS same, nullif(upper(regexp_extract(trim(raw_b), '^([A-Za-z]{{1,5}})[0-9]{{2,}}[A-Za-z]?$', 1)), '') AS letters FROM e""")
def outline_codes(t: Tables) -> DataFrame:
    codes = t.spark.sql(_CODES.replace("FROM part", "FROM {p}"), p=t.part)
    return codes.select("p_partkey", ops.outline_code(F.col("a")).alias("code"), ops.same_outline(F.col("a"), F.col("b")).alias("same"), ops.outline_letters(F.col("b")).alias("letters"))


_ANSWER = """case event_id % 4 when 0 then 'Here: {"pitch": {"value": ' || cast(event_id % 50 as string) || ', "page": ' || cast(event_id % 7 as string) || '}} end' when 1 then '{"pitch": ' || cast(event_id as string) || '}'
 when 2 then 'nothing' else '{"pitch": {"value": "x", "page": 2}, "span": {"value": ' || cast(event_id as string) end"""


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN cast(event_id % 50 AS VARCHAR) WHEN 1 THEN cast(event_id AS VARCHAR) WHEN 3 THEN 'x' END AS value,
CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 7 > 0 THEN cast(event_id % 7 AS INTEGER) END WHEN 3 THEN 2 END AS page FROM events""")
def model_answers(t: Tables) -> DataFrame:
    """Fields of answers that are wrapped in prose, bare, missing, or cut off in their last value."""
    doc = t.events.selectExpr("event_id", f"{_ANSWER} as answer").withColumn("doc", J.tolerant_object(F.col("answer")))
    value, page = J.enveloped(F.col("doc"), "pitch")
    return doc.select("event_id", value.alias("value"), page.alias("page"))
