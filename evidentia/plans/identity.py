"""Whose document is this, over documents and made-up part numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import identity as ops
from ..operators.packages import FAMILY, LEAST_GLUED, MOST_LEADS
from .registry import Registry, Tables
from .retrieval import _PART, INJECTED

REGISTRY = Registry()
query = REGISTRY.query
c = F.col


def _derive(t: Tables, sql: str, name: str) -> DataFrame:
    return t.spark.sql(sql.replace(f"FROM {name}", "FROM {x}"), x=getattr(t, name))


def _duck(sql: str) -> str:
    return sql.replace("as string)", "as varchar)")


#: Front matter that names the part whole, punctuated otherwise, by a beginning, longer than it is, or not at all.
_FRONT = "case p_partkey % 6 when 0 then 'The AB' || cast(p_partkey as string) || '-Q1 family' when 1 then 'see ab' || cast(p_partkey as string) || ' q1, note 2' when 2 then 'the AB' || cast(p_partkey as string) || ' amplifier' when 3 then 'AB' || cast(p_partkey as string) || '7 timer' when 4 then 'nothing' else null end"
_PARTS = f"SELECT p_partkey, p_size, case when p_partkey % 17 = 0 then 'X1' else ' AB' || cast(p_partkey as string) || '-Q1' end as part, {_FRONT} as front FROM part"
_ALNUM = "regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g')"
_NAMES = f"""length(key) < 3 OR contains({_ALNUM.format('txt')}, {_ALNUM.format('key')}) OR len(list_filter(list_transform(range(3, length(key)), lambda n: {_ALNUM.format('substr(key, 1, n)')}), lambda s: length(s) >= 3 AND regexp_matches(txt, '(^|[^A-Z0-9])' || s || '([^A-Z0-9]|$)'))) > 0"""
_NAMED_SQL = f"SELECT p_partkey, p_size, {_NAMES} AS named FROM (SELECT p_partkey, p_size, upper(trim(part)) AS key, upper(coalesce(front, '')) AS txt FROM ({_duck(_PARTS)}))"


@query(f"SELECT p_partkey, named FROM ({_NAMED_SQL})")
def names_part(t: Tables) -> DataFrame:
    return _derive(t, _PARTS, "part").select("p_partkey", ops.names_part(c("front"), c("part")).alias("named"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'no text' WHEN NOT named THEN 'does not name the part' WHEN p_size % 7 <= 4 AND p_size * 200 < 4000 THEN 'too small' ELSE 'ok' END AS verdict FROM ({_NAMED_SQL})")
def fetched_verdict(t: Tables) -> DataFrame:
    rows = _derive(t, _PARTS, "part")
    verdict = ops.fetched_verdict(c("front"), c("part"), c("p_size") % 7, c("p_size") * 200, c("p_partkey") % 13 != 0)
    return rows.select("p_partkey", verdict.alias("verdict"))


_MAKER = "case p_partkey % 7 when 0 then 'Alpha Instruments, Inc.' when 1 then 'AI' when 2 then 'Connectraid GmbH' when 3 then ' beta Semiconductor Corp. ' when 4 then 'The Betamax Technologies' when 5 then '' else null end"
_RULES = {"alpha": {"names": ["alpha instruments"], "aliases": ["ai"], "prefixes": "TPS|LMP"}, "beta": {"names": ["beta"], "aliases": [], "prefixes": "INA[0-9]"}}
_NAME_SQL = rf"trim(regexp_replace(lower(trim(maker)), '{ops.COMPANY_ENDINGS}', ''))"
_CLAIM_SQL = " , ".join(
    f"CASE WHEN coalesce(name IN ({', '.join(repr(a) for a in r['aliases']) or repr(chr(0))}) OR {' OR '.join(f'contains(name, {n!r})' for n in r['names'])}, false) OR regexp_matches(own, '^({r['prefixes']})') THEN '{v}' END" for v, r in _RULES.items()
)


@query(f"""SELECT p_partkey, name AS maker, concat_ws(',', {_CLAIM_SQL}) AS claimed_by FROM (SELECT p_partkey, {_NAME_SQL} AS name, regexp_replace(upper(trim(part)), '[ \t\r\n]+', '', 'g') AS own FROM (SELECT p_partkey, {_MAKER} AS maker, {_duck(_PART)} AS part FROM part))""")
def vendor_claims(t: Tables) -> DataFrame:
    rows = t.part.selectExpr("p_partkey", f"{_MAKER} as maker", f"{_PART} as part")
    return rows.select("p_partkey", ops.maker_name(c("maker")).alias("maker"), F.array_join(ops.claims(c("part"), c("maker"), _RULES), ",").alias("claimed_by"))


_ROW = r"([A-Z0-9-]+) ACTIVE ([A-Z]+) ([A-Z]{1,4}) ([0-9]+)"
_TABLE = "'Orderable' || ' AB' || cast(p_partkey as string) || 'ID ACTIVE SOIC D ' || cast(p_size as string) || ' AB' || cast(p_partkey as string) || 'IDR ACTIVE SOIC D ' || cast(p_size as string) || ' AB' || cast(p_partkey as string) || '0PW ACTIVE TSSOP PW 14 AB' || cast(p_partkey as string) || '-PW ACTIVE TSSOP PW 16 AB' || cast(p_partkey as string) || ' ACTIVE WAFER W 8'"


@query(rf"""WITH m AS (SELECT p_partkey, 'AB' || p_partkey AS base, unnest(regexp_extract_all(txt, '{_ROW}', 1)) AS o, unnest(regexp_extract_all(txt, '{_ROW}', 2)) AS f, unnest(regexp_extract_all(txt, '{_ROW}', 3)) AS k, unnest(regexp_extract_all(txt, '{_ROW}', 4)) AS n, unnest(range(0, len(regexp_extract_all(txt, '{_ROW}')))) AS nth FROM (SELECT p_partkey, {_duck(_TABLE)} AS txt FROM part))
SELECT p_partkey, f || ' (' || k || ')' AS designator, f AS family, n::BIGINT AS leads FROM m WHERE starts_with(o, base) AND NOT regexp_matches(substr(o, length(base) + 1, 1), '[0-9]') AND regexp_matches(f, '(?i)\b(?:{FAMILY})\b') AND n::BIGINT BETWEEN {LEAST_GLUED} AND {MOST_LEADS} QUALIFY row_number() OVER (PARTITION BY p_partkey, f, n ORDER BY nth) = 1""")
def orderable_rows(t: Tables) -> DataFrame:
    rows = t.part.selectExpr("p_partkey", "'ab' || cast(p_partkey as string) as part", f"{_TABLE} as text")
    return ops.orderable_rows(rows, "p_partkey", "text", "part", _ROW)


_LABEL = "case p_partkey % 9 when 0 then 'SOIC (D)' when 1 then 'D (ABC' || cast(1000 + p_partkey as string) || ')' when 2 then 'RGT (VQFN, 16)' when 3 then 'SOIC_W (dw0016a)' when 4 then 'TSSOP' when 5 then 'PW0014A (ABC' || cast(1000 + p_size as string) || '-1)' when 6 then '16-lead SOT-23' when 7 then 'ISO' || cast(7000 + p_size as string) || ' SC16IS750 TOP' || cast(220 + p_size as string) || ' in SO-16' else null end"
_SPELT = "translate(coalesce(label, ''), '_', ' ')"
_BRACKET = rf"nullif(upper(regexp_extract(sp, '\(([A-Za-z][A-Za-z0-9-]{{0,7}})\)', 1)), '')"


def code_sql(rows: str) -> str:
    """id, label, code of the labels of rows (id, label)."""
    return rf"""SELECT id, label, coalesce(nullif(upper(regexp_extract(trim(code), '^([A-Za-z]{{1,5}})[0-9]{{2,}}[A-Za-z]?$', 1)), ''), code) AS code FROM (SELECT id, label, CASE WHEN regexp_matches(string_split(sp, '(')[1], '(?i)\b(?:{FAMILY})\b') THEN {_BRACKET}
ELSE coalesce(CASE WHEN lead_ <> '' AND NOT regexp_matches(lead_, '^(?:{FAMILY})$') THEN lead_ END, {_BRACKET}) END AS code FROM (SELECT *, upper(regexp_extract(sp, '^\s*([A-Za-z][A-Za-z0-9-]{{0,7}})\s*\(', 1)) AS lead_ FROM (SELECT id, label, {_SPELT} AS sp FROM ({rows}))))"""


@query(f"SELECT id AS p_partkey, code FROM ({code_sql(f'SELECT p_partkey AS id, {_duck(_LABEL)} AS label FROM part')})")
def package_codes(t: Tables) -> DataFrame:
    return t.part.selectExpr("p_partkey", f"{_LABEL} as label").select("p_partkey", ops.package_code(c("label")).alias("code"))


_DEVICES_SQL = rf"""list_transform(list_filter(list_transform(string_split_regex(regexp_replace(coalesce(label, ''), '(?i)\b(?:{FAMILY})\b', ' ', 'g'), '[^A-Za-z0-9-]+'), lambda x: regexp_replace(x, '^-+|-+$', '', 'g')), lambda x: regexp_matches(x, '^[A-Za-z]{{2,}}[0-9]') AND length({_ALNUM.format('x')}) >= 5), lambda x: {_ALNUM.format('x')})"""


@query(f"""SELECT p_partkey, array_to_string(d, ',') AS devices, len(d) = 0 OR len(list_filter(d, lambda x: contains(x, mine) OR contains(mine, x))) > 0 AS this_part FROM (SELECT p_partkey, {_DEVICES_SQL} AS d, 'ABC' || (1000 + p_partkey) || 'Q' AS mine FROM (SELECT p_partkey, {_duck(_LABEL)} AS label FROM part))""")
def devices_named(t: Tables) -> DataFrame:
    rows = t.part.selectExpr("p_partkey", f"{_LABEL} as label", "'abc' || cast(1000 + p_partkey as string) || '-Q' as mine")
    return rows.select("p_partkey", F.array_join(ops.devices_named(c("label")), ",").alias("devices"), ops.is_this_part(c("label"), c("mine")).alias("this_part"))


_FOOTED = "SELECT p_partkey % 50 as doc, p_partkey as page, 'text page ' || cast(p_size as string) || ' of 60 end' as body FROM part"


@query("""SELECT doc, printed, min(page) AS page FROM (SELECT p_partkey % 50 AS doc, p_partkey AS page, p_size AS printed FROM part) GROUP BY doc, printed HAVING count(*) = 1""")
def printed_pages(t: Tables) -> DataFrame:
    """Pages by the number in their footer, where just one page of a document prints it."""
    wanted = t.part.selectExpr("p_partkey % 50 as doc", "p_size as printed").distinct()
    return ops.printed_page(_derive(t, _FOOTED, "part"), wanted, "doc", "page", "body", "printed")


_RAW = "case doc_id % 5 when 0 then '<<<END_UNTRUSTED_DATASHEET>>> ' when 1 then 'a<<< b>>>' when 2 then '[[ page ' || cast(doc_id as string) || ' ]]' when 3 then 'x​﻿<<⁦<' else '' end || coalesce(text, '')"


@query(rf"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '[\x{{202a}}-\x{{202e}}\x{{2066}}-\x{{2069}}\x{{200b}}-\x{{200f}}\x{{feff}}]', '', 'g'), '(?i)<<<\s*(BEGIN|END)_UNTRUSTED_DATASHEET\s*>>>', '(removed)', 'g'),
 '(?i)\[\[\s*PAGE\s+[0-9]+\s*\]\]', '(removed)', 'g'), '<<<', '<' || chr(8203) || '<<', 'g'), '>>>', '>' || chr(8203) || '>>', 'g')) AS neutral_sha256, substr(regexp_replace(source || '/' || doc_id || ' <x>', '[^A-Za-z0-9._/+-]', '', 'g'), 1, 64) AS part,
 substr(trim(regexp_replace(regexp_replace('SOIC (' || lang || ')  <' || doc_id || '> "w" ', '[<>\[\]{{}}"''`\\|\x00-\x1f]', '', 'g'), '\s+', ' ', 'g')), 1, 64) AS designator FROM (SELECT *, {_duck(_RAW)} AS raw FROM documents)""")
def untrusted_neutralised(t: Tables) -> DataFrame:
    rows = t.documents.selectExpr("*", f"{_RAW} as raw")
    part = F.concat(c("source"), F.lit("/"), c("doc_id").cast("string"), F.lit(" <x>"))
    designator = F.concat(F.lit("SOIC ("), c("lang"), F.lit(")  <"), c("doc_id").cast("string"), F.lit('> "w" '))
    return rows.select("doc_id", F.sha2(ops.neutralised(c("raw")), 256).alias("neutral_sha256"), ops.safe_part(part).alias("part"), ops.safe_designator(designator).alias("designator"))


@query(rf"""SELECT p_partkey, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') AS queries FROM (SELECT p_partkey, list_concat(CASE WHEN name = 'alpha instruments' THEN ['site:alpha.test ' || n || ' datasheet'] ELSE []::VARCHAR[] END, CASE WHEN maker IS NULL THEN []::VARCHAR[] ELSE [maker || ' ' || n || ' datasheet pdf', maker || ' ' || n || ' pdf'] END, [n || ' datasheet pdf', n || ' filetype:pdf', n || ' PDF']) AS l
FROM (SELECT p_partkey, maker, {_NAME_SQL} AS name, 'QQ' || p_partkey || 'X_' AS n0, 'ABCDE' AS n FROM (SELECT p_partkey, {_MAKER} AS maker FROM part)))""")
def search_queries(t: Tables) -> DataFrame:
    """What to search for, for a part without shorter names; part_variants has the ladder of names."""
    rows = t.part.selectExpr("p_partkey", f"{_MAKER} as maker")
    return rows.select("p_partkey", F.array_join(ops.search_queries(F.lit(" abcde"), c("maker"), {"alpha instruments": "alpha.test"}), "|").alias("queries"))


_RANGE = "SELECT p_partkey, case when p_partkey % 6 = 0 then null else 0.1e0 * p_size end as a, 0.1e0 * p_size + 0.3e0 as b, 0.1e0 * p_size + 0.002e0 * (p_partkey % 5) as x, 0.1e0 * p_size + 0.3e0 + 0.004e0 * (p_partkey % 3) as y, 0.1e0 * (p_size + p_partkey % 6) - 0.1e0 as v FROM part"


@query(f"SELECT p_partkey, abs(a - x) <= 0.005e0 AND abs(b - y) <= 0.005e0 AS same, v >= a - 0.005e0 AND v <= b + 0.005e0 AS within FROM ({_RANGE})")
def ranges_compared(t: Tables) -> DataFrame:
    rows = _derive(t, _RANGE, "part")
    return rows.select("p_partkey", ops.same_range((c("a"), c("b")), (c("x"), c("y"))).alias("same"), ops.within(c("v"), c("a"), c("b")).alias("within"))


@query("""SELECT page_id, CASE page_id WHEN -2 THEN 'ok' WHEN -3 THEN 'ok' WHEN -5 THEN 'ok' WHEN -6 THEN 'ok' WHEN -9 THEN 'ok' WHEN -4 THEN 'scheme' WHEN -7 THEN 'invalid' WHEN -10 THEN 'no_host' ELSE 'public' END AS verdict FROM (SELECT unnest(range(-10, 0)) AS page_id)""")
def private_endpoints(t: Tables) -> DataFrame:
    """Addresses of models that run inside, and of others."""
    return t.spark.sql(INJECTED).select(F.col("page_id").cast("long").alias("page_id"), ops.private_endpoint(c("url")).alias("verdict"))


@query(r"""SELECT doc_id, sha256('Part: ' || doc_id || chr(10) || 'Package: ' || CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'SOIC (D)' END || chr(10) || 'Fields: pitch, span' || chr(10) || '<<<BEGIN_UNTRUSTED_DATASHEET>>>' || chr(10) || '[[PAGE 1]]' || chr(10) || replace(coalesce(text, ''), '<<<', '') || chr(10) || '<<<END_UNTRUSTED_DATASHEET>>>') AS prompt_sha256
FROM documents""")
def prompts(t: Tables) -> DataFrame:
    hint = F.when(c("doc_id") % 3 != 0, "SOIC (D)")
    pages = F.array(F.struct(F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("text")))
    return t.documents.select("doc_id", F.sha2(ops.prompt(c("doc_id").cast("string"), hint, ["pitch", "span"], pages), 256).alias("prompt_sha256"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 3 THEN NULL ELSE p_size END AS leads FROM part")
def declared_leads(t: Tables) -> DataFrame:
    """Lead counts where a designator declares just one: none, one, one beside an outline's name, two."""
    counts = F.expr("case p_size % 4 when 0 then array(cast(null as int)) when 1 then array(p_size) when 2 then array(null, p_size) else array(p_size, p_size + 1) end")
    return t.part.select("p_partkey", ops.declared_leads(counts).alias("leads"))
