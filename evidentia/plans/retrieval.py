"""Links of pages and candidates for parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as ops
from .registry import Registry, Tables

REGISTRY = Registry()
query = REGISTRY.query

#: Pages that the tables lack: document links, redirects, addresses inside, a challenge.
INJECTED = """SELECT * FROM (VALUES
 (-1, 'https://maker.example.com/p/1', '<a href="/ds/LM358.pdf">a</a><a href="https://x.test/download?f=pdf">b</a><a href="/ds/LM358.pdf">a</a><a href="mailto:q@x.test">m</a>'),
 (-2, 'http://localhost:8080/x', '<a href="https://go.test/r?uddg=https%3A%2F%2Fmaker.example.com%2Fds%2FINA240A1.pdf&amp;k=1">r</a><a href="//cdn.test/x.pdf?v=2">c</a>'),
 (-3, 'http://169.254.169.254/latest', 'Please verify you are human to continue'),
 (-4, 'ftp://files.test/a', '<a href="HTTP://UP.test/a">u</a>'),
 (-5, 'http://[::ffff:10.0.0.1]/a', ''), (-6, 'http://172.20.1.9/', 'Too Many Requests'), (-7, 'nonsense', ''), (-8, 'https://8.8.8.8/dns', ''), (-9, 'https://svc.internal/x', ''), (-10, 'https:///x', '')
) AS v(page_id, url, html)"""
PAGES_SQL = f"(SELECT page_id, url, html FROM pages UNION ALL {INJECTED})"


def pages(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url", "html").union(t.spark.sql(INJECTED))


LINKS_SQL = f"""WITH raw AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, unnest(l) AS raw, unnest(range(0, len(l))) AS ord
  FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM {PAGES_SQL})),
un AS (SELECT page_id, base, ord, replace(raw, '&amp;', '&') AS raw FROM raw),
dec AS (SELECT page_id, base, ord, CASE WHEN regexp_extract(raw, '[?&](?:uddg|u)=(https?[^&#]*)', 1) <> '' THEN url_decode(regexp_extract(raw, '[?&](?:uddg|u)=(https?[^&#]*)', 1)) ELSE raw END AS raw FROM un),
links AS (SELECT page_id, CASE WHEN starts_with(raw, '//') THEN 'https:' || raw WHEN starts_with(raw, '/') AND base <> '' THEN base || raw ELSE raw END AS url, min(ord) AS ord
  FROM dec GROUP BY ALL HAVING regexp_matches(url, '^https?://'))"""


@query(f"{LINKS_SQL} SELECT * FROM links")
def page_links(t: Tables) -> DataFrame:
    return ops.links(pages(t)).withColumn("ord", F.col("ord").cast("long"))


@query(f"""{LINKS_SQL} SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS nth FROM links
WHERE regexp_matches(lower(url), '[.]pdf([?#]|$)') OR regexp_matches(lower(url), 'download.*pdf') QUALIFY nth <= 8""")
def document_links(t: Tables) -> DataFrame:
    return ops.document_links(ops.links(pages(t))).select("page_id", "url", F.col("nth").cast("long").alias("nth"))


@query(f"""{LINKS_SQL}, hosts AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS links, count(DISTINCT page_id) AS pages FROM links GROUP BY 1)
SELECT host, links, pages, row_number() OVER (ORDER BY links DESC, host) AS rank FROM hosts QUALIFY rank <= 20""")
def page_link_host_rank(t: Tables) -> DataFrame:
    """A report: the twenty hosts with most links. Sorted and cut before anything is numbered."""
    hosts = ops.links(pages(t)).groupBy(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    hosts = hosts.agg(F.count(F.lit(1)).alias("links"), F.count_distinct("page_id").alias("pages"))
    top = hosts.orderBy(F.col("links").desc(), "host").limit(20)
    ranked = ops.top_ranked(top.withColumn("_one", F.lit(1)), ["_one"], [F.col("links").desc(), F.col("host")], 20)
    return ranked.select("host", "links", "pages", F.col("rank").cast("long").alias("rank"))


_MARKS = " OR ".join(f"contains(lower(substr(html, 1, 4000)), '{m}')" for m in T.BLOCK_MARKERS)


@query(f"SELECT page_id, url FROM {PAGES_SQL} WHERE {_MARKS}")
def blocked_pages(t: Tables) -> DataFrame:
    return pages(t).where(T.looks_blocked(F.col("html"), T.BLOCK_MARKERS)).select("page_id", "url")


_V4 = r"(regexp_matches(h, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$') AND len(list_filter(o, lambda x: x IS NULL OR x > 255)) = 0 AND (o[1] IN (0, 10, 127) OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 100 AND o[2] BETWEEN 64 AND 127) OR o[1] >= 224))"


@query(rf"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
 regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)), '^\[|\]$', '', 'g') AS bare FROM {PAGES_SQL}),
 v AS (SELECT *, regexp_replace(bare, '^::ffff:', '') AS h FROM u), w AS (SELECT *, list_transform(string_split(h, '.'), lambda x: try_cast(x AS INTEGER)) AS o FROM v)
SELECT page_id, CASE WHEN scheme = '' THEN 'invalid' WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN bare = '' THEN 'no_host'
 WHEN bare IN ('localhost', 'metadata.google.internal', 'metadata') OR suffix(bare, '.localhost') OR suffix(bare, '.local') OR suffix(bare, '.internal') OR suffix(bare, '.localdomain') THEN 'internal'
 WHEN bare IN ('::1', '::') OR regexp_matches(bare, '^f[cd][0-9a-f]{{2}}:') OR regexp_matches(bare, '^fe[89ab][0-9a-f]:') OR coalesce({_V4}, false) THEN 'private' ELSE 'ok' END AS verdict FROM w""")
def url_guard(t: Tables) -> DataFrame:
    return pages(t).select("page_id", T.url_verdict(F.col("url")).alias("verdict"))


@query(r"""SELECT page_id, substr(CASE WHEN c = '' THEN 'datasheet' ELSE c END, 1, 128) || '.pdf' AS file_name FROM (SELECT page_id,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[.][pP][dD][fF]$', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS c FROM """ + PAGES_SQL + ")")
def file_names(t: Tables) -> DataFrame:
    return pages(t).select("page_id", T.file_name(F.col("url")).alias("file_name"))


#: Part numbers as people type them, for either engine.
_PART = "case when p_partkey % 4 = 0 then ' tps' || cast(7000 + p_partkey as string) || ' ' when p_partkey % 4 = 1 then 'Lmp' || cast(p_partkey as string) || '-SP' when p_partkey % 4 = 2 then 'ina' || cast(100 + p_partkey as string) || 'A' || cast(p_size % 9 as string) else '5962R' || cast(1900000 + p_partkey as string) || 'VXC_X' end"
_VARIANTS = r"""list_filter(l, lambda v, i: v <> '' AND list_position(l, v) = i) FROM (SELECT p_partkey, part, [n, regexp_replace(n, '[-_].*$', ''), regexp_replace(n, '^(.*[0-9])[A-Z]+[0-9]*$', '\1'),
 CASE WHEN s <> n AND length(s) >= 5 AND regexp_matches(s, '[0-9]$') THEN s ELSE '' END] AS l FROM (SELECT *, regexp_replace(n, '[0-9]{2}$', '') AS s FROM
 (SELECT p_partkey, part, regexp_replace(upper(trim(part)), '[ \t\r\n]+', '', 'g') AS n FROM (SELECT p_partkey, """ + _PART + " AS part FROM part))))"
#: Makers: the prefixes they claim, and how they name documents. A short list of fixed size.
_VENDORS = "(VALUES ('alpha', 'TPS|LMP', 'https://alpha.test/lit/{part}.pdf'), ('beta', 'INA', 'https://docs.beta.test/{part}/download-pdf'), ('gamma', '5962', 'https://alldatasheet.test/{part}.html')) AS v(vendor, prefix, template)"


def _parts(t: Tables) -> DataFrame:
    return t.part.selectExpr("p_partkey", f"{_PART} as part")


@query(f"SELECT p_partkey, array_to_string(v, '|') AS variants FROM (SELECT p_partkey, {_VARIANTS.replace(' FROM ', ' AS v FROM ', 1)})")
def part_variants(t: Tables) -> DataFrame:
    return _parts(t).select("p_partkey", F.array_join(T.part_variants(F.col("part")), "|").alias("variants"))


_CANDIDATES = f"""SELECT p_partkey, vendor, replace(template, '{{part}}', lower(variant)) AS url, regexp_matches(n, '^(' || prefix || ')') AS claimed, nth, variants
FROM (SELECT p_partkey, unnest(v) AS variant, unnest(range(0, len(v))) AS nth, v[1] AS n, v AS variants FROM (SELECT p_partkey, {_VARIANTS.replace(' FROM ', ' AS v FROM ', 1)})) CROSS JOIN {_VENDORS}"""


def _candidates(t: Tables) -> DataFrame:
    return ops.candidate_urls(_parts(t), t.spark.sql(f"SELECT * FROM {_VENDORS}"), "p_partkey", "part")


@query(f"SELECT p_partkey, vendor, url, claimed, nth FROM ({_CANDIDATES})")
def candidate_urls(t: Tables) -> DataFrame:
    return _candidates(t).withColumn("nth", F.col("nth").cast("long"))


_SCORE = "CASE WHEN regexp_matches(url, '[.]pdf([?#]|$)') THEN 100 ELSE 0 END + CASE WHEN len(list_filter(variants, lambda v: contains(url, lower(v)))) > 0 THEN 20 ELSE 0 END + CASE WHEN contains(url, 'docs.beta.test') OR contains(url, 'alpha.test') THEN 12 ELSE 0 END - CASE WHEN contains(url, 'alldatasheet') THEN 30 ELSE 0 END"


@query(f"SELECT p_partkey, url, score, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, url) AS rank FROM (SELECT p_partkey, url, {_SCORE} AS score FROM ({_CANDIDATES})) QUALIFY rank <= 4")
def candidate_topk(t: Tables) -> DataFrame:
    rows = _candidates(t).join(_parts(t), "p_partkey").withColumn("names", T.part_variants(F.col("part")))
    score = ops.candidate_score(F.col("url"), F.col("names"), ["docs.beta.test", "alpha.test"], ["alldatasheet"])
    rows = rows.select("p_partkey", "url", score.alias("score"))
    return ops.top_ranked(rows, ["p_partkey"], [F.col("score").desc(), F.col("url")], 4).select("p_partkey", "url", "score", F.col("rank").cast("long").alias("rank"))


_ATTEMPTS = "SELECT s_suppkey, r as rank, case when (s_suppkey + r) % 5 = 0 then 'hit' when (s_suppkey + 2 * r) % 11 = 0 then 'hard' when (s_suppkey + r) % 3 = 0 then 'soft' else 'miss' end as outcome, s_name || '#' || cast(r as string) as ref FROM supplier CROSS JOIN (VALUES (1), (2), (3)) AS v(r)"


@query(f"""SELECT s_suppkey, arg_min(ref, rank) FILTER (outcome = 'hit') AS ref, min(rank) FILTER (outcome = 'hit') AS resolved_by,
CASE WHEN count(*) FILTER (outcome = 'hit') > 0 THEN 'ok' WHEN count(*) FILTER (outcome = 'hard') > 0 THEN 'failed' ELSE 'miss' END AS status FROM ({_ATTEMPTS}) GROUP BY s_suppkey""")
def resolver_fallback(t: Tables) -> DataFrame:
    attempts = t.spark.sql(_ATTEMPTS.replace("FROM supplier", "FROM {s}"), s=t.supplier)
    return ops.first_hit(attempts, ["s_suppkey"], "rank", "outcome", "ref")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_docs(t: Tables) -> DataFrame:
    return ops.orphans(t.documents.select("doc_id", "source"), t.labels, "doc_id")


#: What was fetched, made of part keys: documents, pages with links, other things, failures; and documents behind links.
_FETCHED = """SELECT 'https://h.test/' || cast(p_partkey as string) as url, case when p_partkey % 7 = 0 then 404 else 200 end as status, case p_partkey % 5 when 0 then 'Application/PDF' when 1 then 'text/html; charset=utf-8' when 2 then 'text/plain' when 3 then 'text/html' end as content_type,
 case when p_partkey % 5 = 3 and p_partkey % 2 = 0 then 'https://h.test/' || cast(p_partkey as string) || '.PDF?v=1' when p_partkey % 11 > 0 then 'https://h.test/' || cast(p_partkey as string) end as final_url,
 '<a href="/d/' || cast(p_partkey * 3 % 500 as string) || '.pdf">x</a> <a href="/about">y</a> <a href="https://h.test/d/' || cast(p_partkey * 7 % 500 as string) || '.pdf">z</a>' as html FROM part
 UNION ALL SELECT 'https://h.test/d/' || cast(p_partkey as string) || '.pdf', case when p_partkey % 3 = 2 then 500 else 200 end, case when p_partkey % 3 = 0 then 'application/pdf' else 'text/html' end, case when p_partkey % 4 = 1 then 'https://h.test/login' end, '' FROM part"""
_TRIED = "SELECT p_partkey as lookup, tier, rank, case when (p_partkey + rank) % 13 = 0 then 'http://10.0.0.1/x.pdf' else 'https://h.test/' || cast((p_partkey * 31 + tier * 97 + rank * 11) % 2500 as string) end as url FROM part CROSS JOIN (VALUES (0, 1), (1, 1), (1, 2), (1, 13), (2, 1), (2, 4)) AS v(tier, rank) WHERE (p_partkey + tier) % 5 > 0"
_SEARCHES = "SELECT p_partkey as lookup, tier, (p_partkey + tier * 3) % 4 = 0 as blocked FROM part CROSS JOIN (VALUES (1), (2)) AS v(tier)"
_VARCHAR = lambda sql: sql.replace("as string)", "as varchar)")
_PDF = r"(coalesce(contains(lower(content_type), 'pdf'), false) OR regexp_matches(final_url, '(?i)\.pdf(\?|#|$)'))"
INSPECTED_SQL = rf"""WITH f AS (SELECT url, coalesce(final_url, url) AS final_url, content_type, html FROM ({_VARCHAR(_FETCHED)}) WHERE status = 200), g AS (SELECT *, {_PDF} AS pdf FROM f),
l AS (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw, unnest(range(0, len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS ord FROM g WHERE NOT pdf AND contains(content_type, 'html')),
d AS (SELECT l.url, arg_min(g.final_url, ord) AS led FROM l JOIN g ON g.url = CASE WHEN starts_with(raw, '/') THEN 'https://h.test' || raw ELSE raw END AND g.pdf WHERE contains(raw, '.pdf') GROUP BY l.url),
k AS (SELECT url, CASE WHEN pdf THEN final_url ELSE led END AS pdf_url, CASE WHEN pdf THEN url WHEN led IS NOT NULL THEN final_url END AS source_url FROM g LEFT JOIN d USING (url))
SELECT lookup, tier, rank, c.url, pdf_url, source_url FROM ({_VARCHAR(_TRIED)}) c LEFT JOIN k ON k.url = c.url"""


def _inspected(t: Tables) -> DataFrame:
    made = lambda sql: t.spark.sql(sql.replace("FROM part", "FROM {p}"), p=t.part)
    return ops.inspected(made(_TRIED), made(_FETCHED), ["lookup", "tier", "rank"])


@query(INSPECTED_SQL)
def candidates_inspected(t: Tables) -> DataFrame:
    """What each candidate of a lookup leads to."""
    return _inspected(t)


@query(f"""WITH i AS ({INSPECTED_SQL}), s AS ({_SEARCHES}), e AS (SELECT lookup, min(tier) AS ended FROM s WHERE blocked GROUP BY lookup),
b AS (SELECT lookup, arg_min(pdf_url, tier * 100 + rank) AS pdf_url, arg_min(source_url, tier * 100 + rank) AS source_url FROM i LEFT JOIN e USING (lookup) WHERE pdf_url IS NOT NULL AND (tier = 0 OR rank <= 12) AND (ended IS NULL OR tier < ended) GROUP BY lookup)
SELECT p_partkey AS lookup, pdf_url, source_url, pdf_url IS NULL AND ended IS NOT NULL AS search_blocked FROM part LEFT JOIN b ON b.lookup = p_partkey LEFT JOIN e ON e.lookup = p_partkey""")
def documents_located(t: Tables) -> DataFrame:
    """Where each lookup finds its document, or whether it could not look."""
    return ops.located(_inspected(t), t.spark.sql(_SEARCHES.replace("FROM part", "FROM {p}"), p=t.part), "lookup")
