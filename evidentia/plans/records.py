"""Records: overlays, projections, edits and settings, over records derived from the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records as ops
from .evidence import MERGED_SQL, merged
from .geometry import RECORDS_SQL, records
from .registry import Registry, Tables

REGISTRY = Registry()
query = REGISTRY.query
c = F.col

#: What people supplied, for some parts.
_GIVEN = {
    "given_pitch": "case when p_partkey % 3 = 0 then 0.5e0 end", "given_body_width": "case when p_partkey % 5 = 0 then 4.0e0 end", "given_thermal_length": "case when p_partkey % 4 = 1 then 2.5e0 end",
    "given_land_length": "case when p_partkey % 6 = 0 then 1.75e0 end", "given_land_span": "case when p_partkey % 10 = 0 then 5.5e0 end", "given_land_span_cross": "case when p_partkey % 7 = 0 then 5.25e0 end",
}
_FILLED, _CORRECTED = ["pitch", "body_width", "thermal_length"], ["land_length", "land_span", "land_span_cross"]


@query(f"SELECT p_partkey, {', '.join(f'coalesce({n}, given_{n}) AS {n}' for n in _FILLED)}, {', '.join(f'coalesce(given_{n}, {n}) AS {n}' for n in _CORRECTED)} FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _GIVEN.items())} FROM ({RECORDS_SQL}))")
def supplied_overlay(t: Tables) -> DataFrame:
    rows = records(t).selectExpr("*", *(f"{e} as {n}" for n, e in _GIVEN.items()))
    return ops.overlaid(rows, _FILLED, _CORRECTED).select("p_partkey", *_FILLED, *_CORRECTED)


def _wide(t: Tables) -> DataFrame:
    """One record for each order: its five fields as structs."""
    one = F.struct("value", "confidence", "method", "citation")
    return merged(t).groupBy("k").agg(*(F.max(F.when(c("f") == n, one)).alias(f"f{n}") for n in range(1, 6)))


@query(f"""SELECT k, coalesce(max(CASE WHEN f = 1 THEN value END)::VARCHAR, 'Unknown') AS f1, {', '.join(f'max(CASE WHEN f = {n} THEN value END) AS f{n}' for n in range(2, 6))} FROM ({MERGED_SQL}) GROUP BY k""")
def provenance_stripped(t: Tables) -> DataFrame:
    return ops.stripped(_wide(t), "k", [f"f{n}" for n in range(1, 6)], ["f1"])


@query(f"SELECT k, f, value FROM ({MERGED_SQL}) WHERE value IS NOT NULL AND citation IS NOT NULL")
def cited_values(t: Tables) -> DataFrame:
    return ops.cited_only(merged(t)).select("k", "f", "value")


@query(f"""SELECT k, max(CASE WHEN f = 2 THEN value END) AS read_, max(CASE WHEN f = 3 THEN CASE WHEN value IS NULL THEN k ELSE value END END) AS put_, max(CASE WHEN f = 3 THEN citation END) AS beside FROM ({MERGED_SQL}) GROUP BY k HAVING count(*) FILTER (f = 3) > 0""")
def field_paths(t: Tables) -> DataFrame:
    """A field read by its path, and another one set where it was unknown, the citation beside it kept."""
    rows = _wide(t).where("f3 is not null")
    rows = ops.put(rows, "f3.value", F.coalesce(ops.at(rows, "f3.value"), ops.at(rows, "k")))
    return rows.select("k", ops.at(rows, "f2.value").alias("read_"), ops.at(rows, "f3.value").alias("put_"), ops.at(rows, "f3.citation").alias("beside"))


@query("SELECT p_partkey, p_name AS part_number, 'deterministic' AS method, 3::BIGINT AS unknown FROM part")
def record_blank(t: Tables) -> DataFrame:
    """New records: the part number is certain, the other fields are unknown."""
    fields = {"part_number": "string", "pitch": "double", "pin_count": "int", "pins": "array<string>"}
    rows = ops.blank(t.part.select("p_partkey", "p_name"), "p_partkey", fields, {"part_number": c("p_name")})
    unknown = sum((F.when(c(f"{n}.value").isNull(), 1).otherwise(0) for n in fields), F.lit(0))
    return rows.select("p_partkey", c("part_number.value").alias("part_number"), c("part_number.method").alias("method"), unknown.cast("long").alias("unknown"))


_PACKAGE_DIMS = "SELECT p_partkey, 'pk' || cast(w as string) as package, case f when 1 then 'pitch' when 2 then 'body_width' else 'body_length' end as field, case when (p_partkey + w * f) % 5 = 0 then null else 0.1e0 * (p_size + w * f) end as value, case when (p_partkey + 2 * w + f) % 3 = 0 or p_size % 4 < w then null else cast(p_partkey % 40 + w as int) end as citation FROM part CROSS JOIN (VALUES (1), (2)) AS a(w) CROSS JOIN (VALUES (1), (2), (3)) AS b(f)"


@query(f"""SELECT p_partkey, package, max(value) FILTER (field = 'pitch' AND citation IS NOT NULL) AS pitch, max(value) FILTER (field = 'body_width' AND citation IS NOT NULL) AS body_width, max(value) FILTER (field = 'body_length' AND citation IS NOT NULL) AS body_length
FROM ({_PACKAGE_DIMS.replace('as string', 'as varchar')}) GROUP BY p_partkey, package""")
def rekeyed_records(t: Tables) -> DataFrame:
    dims = t.spark.sql(_PACKAGE_DIMS.replace("FROM part", "FROM {p}"), p=t.part)
    return ops.rekeyed(t.part.select("p_partkey"), dims, "p_partkey", "package", "field", ["pitch", "body_width", "body_length"])


_TABLE = "p_size % 2 = 0"
_GRAFT_SQL = f"""SELECT p_partkey, CASE WHEN take THEN 6 + p_size % 7 ELSE pin_count END AS pin_count, CASE WHEN take THEN p_size % 3 = 0 ELSE false END AS exposed_pad, CASE WHEN take AND p_partkey % 4 <> 0 THEN 0.5e0 END AS confidence, take AS grafted
FROM (SELECT *, {_TABLE} AND {{0}} AS take FROM ({RECORDS_SQL}))"""


def _tables(t: Tables) -> DataFrame:
    pins = F.transform(F.sequence(F.lit(1), (6 + c("p_size") % 7).cast("int")), lambda i: i.cast("string"))
    return t.part.select("p_partkey", F.when(F.expr(_TABLE), pins).alias("pins"), (c("p_size") % 3 == 0).alias("exposed_pad"), F.expr("case when p_partkey % 4 <> 0 then cast(p_partkey % 9 as int) end").alias("citation"))


@query(_GRAFT_SQL.format("true"))
def pin_tables_grafted(t: Tables) -> DataFrame:
    return ops.grafted(records(t), _tables(t), "p_partkey").select("p_partkey", "pin_count", "exposed_pad", "confidence", "grafted")


@query(_GRAFT_SQL.format("len(pins) = 0 AND pitch IS NOT NULL"))
def records_for_package(t: Tables) -> DataFrame:
    """Pin tables taken over only where the pins are all that is missing."""
    sole = (F.size("pins") == 0) & c("pitch").isNotNull()
    return ops.grafted(records(t), _tables(t), "p_partkey", sole).select("p_partkey", "pin_count", "exposed_pad", "confidence", "grafted")


@query(f"""SELECT p_partkey, coalesce(list_reduce(list_concat([''], list_transform(pins, lambda p: p || ':' || CASE WHEN p = '3' THEN 'RESET/user' ELSE 'P' || p || '/vlm' END)), lambda a, b: CASE WHEN a = '' THEN b ELSE a || ' ' || b END), '') AS edited FROM ({RECORDS_SQL})""")
def pin_edit(t: Tables) -> DataFrame:
    """The third pin's name as a person types it: theirs from then on."""
    pins = F.transform("pins", lambda p: F.struct(p.alias("number"), F.concat(F.lit("P"), p).alias("name"), F.lit("vlm").alias("method"), F.lit(2).alias("citation")))
    edited = ops.pins_edited(pins, F.lit("3"), F.lit("RESET"))
    return records(t).select("p_partkey", F.array_join(F.transform(edited, lambda p: F.concat(p["number"], F.lit(":"), p["name"], F.lit("/"), p["method"])), " ").alias("edited"))


@query(f"""SELECT k, f, CASE WHEN yes THEN 1.0e0 ELSE confidence END AS confidence, CASE WHEN yes THEN 'user-confirmed' ELSE method END AS method, citation FROM (SELECT *, (k + f) % 6 = 0 AND value IS NOT NULL AS yes FROM ({MERGED_SQL}))""")
def user_confirmed(t: Tables) -> DataFrame:
    rows = merged(t)
    marks = rows.select("k", "f", ((c("k") + c("f")) % 6 == 0).alias("clicked")).where("clicked")
    return ops.confirmed(rows, marks, ["k", "f"]).select("k", "f", "confidence", "method", "citation")


_SETTINGS = """case event_id % 8 when 6 then '{"other": {"densityLevel": "A", "formedLeadSpanMm": 3.0}, "footprintSource": "standard-always"}' when 7 then '{"formedLeadSpanMm": 1e1, "formedLeadContactMm": "2", "densityLevel": ["A"]}' when 0 then '{"densityLevel": "A", "formedLeadSpanMm": ' || cast(event_id % 260 as string) || ', "formedLeadContactMm": 1.5}' when 1 then '{"densityLevel": "X", "footprintSource": "standard-always"}'
 when 2 then '{"formedLeadSpanMm": "12", "formedLeadContactMm": 7}' when 3 then '{"footprintSource": "mine", "formedLeadSpanMm": -4, "formedLeadContactMm": 0.25 }' when 4 then '' else '{"densityLevel": "C", "extra": 1, "formedLeadSpanMm": 10.25, "formedLeadContactMm": 2}' end"""
_WORD = "CASE WHEN json_type(raw, '$.{0}') = 'VARCHAR' THEN raw ->> '$.{0}' END"
_NUMBER = "CASE WHEN json_type(raw, '$.{0}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (raw ->> '$.{0}')::DOUBLE END"


@query(f"""WITH r AS (SELECT event_id, CASE WHEN json_valid(x) THEN x::JSON END AS raw FROM (SELECT event_id, {_SETTINGS.replace('as string', 'as varchar')} AS x FROM events)), p AS (SELECT event_id, {_WORD.format('densityLevel')} AS d, {_WORD.format('footprintSource')} AS s, {_NUMBER.format('formedLeadSpanMm')} AS span, {_NUMBER.format('formedLeadContactMm')} AS contact FROM r),
q AS (SELECT event_id, CASE WHEN d IN ('A', 'B', 'C') THEN d ELSE 'B' END AS density, CASE WHEN s IN ('datasheet-first', 'standard-always') THEN s ELSE 'datasheet-first' END AS source, CASE WHEN span > 0 AND span <= 200 THEN span END AS span, CASE WHEN contact > 0 AND contact <= 5 THEN contact END AS contact FROM p)
SELECT *, concat_ws(',', CASE WHEN span IS NULL THEN 'formedLeadSpanMm' END, CASE WHEN contact IS NULL THEN 'formedLeadContactMm' END) AS missing, span IS NOT NULL AND contact IS NOT NULL AS complete FROM q""")
def settings_parsed(t: Tables) -> DataFrame:
    rows = ops.settings_resolved(t.events.selectExpr("event_id", f"{_SETTINGS} as raw"), "raw")
    return rows.select("event_id", "density", "source", c("formedLeadSpanMm").alias("span"), c("formedLeadContactMm").alias("contact"), F.array_join("missing", ",").alias("missing"), "complete")


@query(f"""SELECT p_partkey, CASE WHEN pitch IS NULL THEN 'not read' ELSE round(pitch, 3)::VARCHAR || ' mm' END AS pitch, CASE WHEN span_min IS NULL OR span_max IS NULL THEN 'not read' WHEN round(span_min, 3) = round(span_max, 3) THEN round(span_min, 3)::VARCHAR || ' mm' ELSE round(span_min, 3)::VARCHAR || ' to ' || round(span_max, 3)::VARCHAR || ' mm' END AS span,
len(pins)::VARCHAR || ' pins: ' || coalesce(array_to_string(list_transform(pins[1:4], lambda p: p || '=P' || p), ', '), '') || CASE WHEN len(pins) > 4 THEN ', ...' ELSE '' END AS pins FROM ({RECORDS_SQL})""")
def display_values(t: Tables) -> DataFrame:
    r = lambda n: F.round(n, 3)
    pins = F.transform("pins", lambda p: F.struct(p.alias("number"), F.concat(F.lit("P"), p).alias("name")))
    return records(t).select("p_partkey", ops.number_shown(r("pitch"), "mm").alias("pitch"), ops.range_shown(r("span_min"), r("span_max")).alias("span"), ops.pins_shown(pins).alias("pins"))


_PIN_ROWS = "case p_size % 6 when 0 then array() when 1 then array('1|A|input', '2|B|odd', 'EP|GND|power') when 2 then array('A1|X|', 'B2|Y|') when 3 then array('1||', '2|B|') when 4 then array('PAD|G|') else array(' 7 | N |output', '8|V|power') end"
_SPLIT = "{{'number': trim(string_split(r, '|')[1]), 'name': trim(string_split(r, '|')[2]), 'kind': string_split(r, '|')[3]}}"


@query(f"""WITH s AS (SELECT p_partkey, list_transform({_PIN_ROWS.replace('array(', 'list_value(').replace('list_value()', '[]::VARCHAR[]')}, lambda r: {_SPLIT.format()}) AS rows FROM part), n AS (SELECT *, list_filter(rows, lambda r: regexp_matches(r.number, '^[0-9]+$')) AS numbered, list_filter(rows, lambda r: NOT regexp_matches(r.number, '^[0-9]+$')) AS others FROM s),
w AS (SELECT *, CASE WHEN len(rows) = 0 THEN 'empty' WHEN len(list_filter(numbered, lambda r: r.name = '')) > 0 THEN 'no name' WHEN len(numbered) = 0 AND len(list_filter(others, lambda r: NOT regexp_matches(r.number, '^[A-Za-z]{{1,2}}[0-9]{{1,3}}$'))) = 0 THEN 'grid array' WHEN len(numbered) = 0 THEN 'no numbered rows' END AS refused FROM n)
SELECT p_partkey, refused, CASE WHEN refused IS NULL THEN len(others) > 0 END AS exposed_pad, CASE WHEN refused IS NULL THEN array_to_string(list_transform(numbered, lambda r: r.number || '=' || r.name || ':' || CASE WHEN r.kind IN ('input', 'output', 'power') THEN r.kind ELSE 'unspecified' END), ' ') END AS pins FROM w""")
def pins_normalised(t: Tables) -> DataFrame:
    parts = lambda r: F.split(r, "[|]")
    rows = t.part.selectExpr("p_partkey", f"cast({_PIN_ROWS} as array<string>) as raw")
    rows = rows.withColumn("rows", F.transform("raw", lambda r: F.struct(parts(r)[0].alias("number"), parts(r)[1].alias("name"), parts(r)[2].alias("kind"))))
    found = rows.select("p_partkey", *(e.alias(n) for n, e in ops.pin_table(c("rows")).items()))
    shown = F.transform("pins", lambda p: F.concat(p["number"], F.lit("="), p["name"], F.lit(":"), p["kind"]))
    return found.select("p_partkey", "refused", "exposed_pad", F.array_join(shown, " ").alias("pins"))


@query(f"""WITH r AS (SELECT *, len(pins) AS n, 7 + 2 * (p_size % 5) AS leads FROM ({RECORDS_SQL})), h AS (SELECT *, p_partkey % 5 = 0 AS exposed, coalesce(NOT (p_partkey % 5 = 0) AND n = leads + 1 AND thermal_length IS NOT NULL AND thermal_width IS NOT NULL AND try_cast(pins[n] AS INTEGER) = n, false) AS hit FROM r)
SELECT p_partkey, exposed OR hit AS exposed_pad, CASE WHEN hit THEN n - 1 ELSE n END AS rows_, CASE WHEN hit AND pin_count = n THEN leads ELSE pin_count END AS pin_count FROM h""")
def thermal_pad_inferred(t: Tables) -> DataFrame:
    """Records whose last pin is the pad under the part: one row more than leads, with the pad's sizes known."""
    made = ops.pad_row_taken_out(c("pins"), (7 + 2 * (c("p_size") % 5)).cast("int"), c("pin_count"), c("thermal_length"), c("thermal_width"), c("p_partkey") % 5 == 0)
    return records(t).select("p_partkey", *(e.alias(n) for n, e in made.items())).select("p_partkey", "exposed_pad", F.size("pins").cast("long").alias("rows_"), "pin_count")


_PASS = "SELECT o_orderkey as k, case f when 1 then 'pins' when 2 then 'pitch' else 'span' end as field, cast(o_custkey % {0} + f as string) as value, cast((o_custkey * f) % {1} as int) as page FROM orders CROSS JOIN (VALUES (1), (2), (3)) AS v(f) WHERE (o_orderkey + f) % {2} <> 0"
_PASSES = [_PASS.format(4, 3, 4), _PASS.format(5, 4, 3)]


@query(f"""SELECT k, field, CASE WHEN first_ THEN v1 ELSE v2 END AS value, CASE WHEN first_ THEN p1 ELSE p2 END AS page FROM (SELECT k, field, a.value AS v1, a.page AS p1, b.value AS v2, b.page AS p2, b.value IS NULL OR (field = 'pins' AND a.value IS NOT NULL AND a.page IS DISTINCT FROM b.page AND a.value <> b.value) AS first_
FROM ({_PASSES[0].replace('as string', 'as varchar')}) a FULL OUTER JOIN ({_PASSES[1].replace('as string', 'as varchar')}) b USING (k, field))""")
def passes_combined(t: Tables) -> DataFrame:
    first, second = (t.spark.sql(q.replace("FROM orders", "FROM {o}"), o=t.orders) for q in _PASSES)
    return ops.passes_combined(first, second, ["k"], "field", "pins")


@query("""SELECT p_partkey, array_to_string(list_sort(list_filter([CASE p_size % 3 WHEN 0 THEN 'pitchMm=' || p_size WHEN 1 THEN 'bodyWidthMm=' || p_size END, 'bodyLengthMm=2'], lambda x: x IS NOT NULL)), ',') AS dims FROM part""")
def dims_coerced(t: Tables) -> DataFrame:
    """Dimensions under short, full and unknown names."""
    short = F.expr("case p_size % 3 when 0 then 'pitch' when 1 then 'bodyWidthMm' else 'colour' end")
    dims = F.create_map(short, c("p_size").cast("string"), F.lit("length"), F.lit("2"))
    named = ops.dims_named(dims, {"pitch": "pitchMm", "width": "bodyWidthMm", "length": "bodyLengthMm"})
    shown = F.array_sort(F.transform(F.map_entries(named), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return t.part.select("p_partkey", F.array_join(shown, ",").alias("dims"))


@query("""SELECT doc_id, source, sha256(coalesce(text, '')) AS sha256, n_chars FROM documents""")
def source_projection(t: Tables) -> DataFrame:
    """Of a fetched source what may leave the house: where it came from and what it hashes to, not its text."""
    return t.documents.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "n_chars")


@query(f"""WITH r AS (SELECT k, count(*) FILTER (method LIKE 'vlm%' AND citation IS NULL AND value IS NOT NULL) AS to_review FROM ({MERGED_SQL}) GROUP BY k), c AS (SELECT k, count(*) AS cited FROM ({MERGED_SQL}) WHERE value IS NOT NULL AND citation IS NOT NULL GROUP BY k)
SELECT o_orderkey AS k, o_orderpriority AS title, to_review, cited FROM orders LEFT JOIN r ON k = o_orderkey LEFT JOIN c USING (k)""")
def readout(t: Tables) -> DataFrame:
    """What a reviewer gets of each record in one row: title, what is to be reviewed, what is cited."""
    rows = merged(t)
    loose = rows.where(c("value").isNotNull() & c("citation").isNull() & c("method").startswith("vlm"))
    review = rows.select("k").distinct().join(loose.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("to_review"))
    cited = ops.cited_only(rows).groupBy("k").agg(F.count(F.lit(1)).alias("cited"))
    return ops.readout(t.orders.select(c("o_orderkey").alias("k"), c("o_orderpriority").alias("title")), [review, cited], "k")


_OFFERED = "SELECT p_partkey, 'SO' || cast(p_size % 3 as string) || case when p_partkey % 4 = 0 then '' else ' (' || cast(w as string) || ')' end as package, case when (p_partkey + w) % 5 = 0 then null else 'D' || cast(w as string) end as outline, case when (p_partkey * w) % 7 = 0 then 0 else p_size % 20 end as rows_ FROM part CROSS JOIN (VALUES (1), (2), (3)) AS v(w)"


@query(f"""WITH o AS (SELECT *, regexp_replace(upper(package), '[^A-Z0-9]', '', 'g') AS key_, count(*) OVER (PARTITION BY p_partkey, regexp_replace(upper(package), '[^A-Z0-9]', '', 'g')) AS n FROM ({_OFFERED.replace('as string', 'as varchar')}))
SELECT p_partkey, CASE WHEN n > 1 AND outline IS NOT NULL THEN package || ' [' || outline || ']' ELSE package END AS option, CASE WHEN rows_ = 0 THEN 'needs-input' WHEN rows_ % 2 = 1 THEN 'unsupported' ELSE 'ships' END AS status, count(*) AS tables_ FROM o GROUP BY ALL""")
def options_from_tables(t: Tables) -> DataFrame:
    """Packages to choose from, one for each pin table; names that collide carry their outline."""
    rows = t.spark.sql(_OFFERED.replace("FROM part", "FROM {p}"), p=t.part)
    options = ops.options_named(rows, "p_partkey", "package", "outline")
    status = F.when(c("rows_") == 0, "needs-input").when(c("rows_") % 2 == 1, "unsupported").otherwise("ships")
    return options.groupBy("p_partkey", "option", status.alias("status")).agg(F.count(F.lit(1)).alias("tables_"))


@query("SELECT c_custkey, coalesce(sum(o_totalprice > 100000)::BIGINT, 0) AS attempts, count(o_orderkey) AS calls FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey".replace("sum(o_totalprice > 100000)", "sum((o_totalprice > 100000)::INTEGER)"))
def ledger_totals(t: Tables) -> DataFrame:
    """Totals of a ledger, zero where it has no line."""
    sums = t.orders.groupBy("o_custkey").agg(F.count_if(c("o_totalprice") > 100_000).alias("a"), F.count(F.lit(1)).alias("n"))
    rows = t.customer.select("c_custkey").join(sums, c("c_custkey") == c("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("a", F.lit(0)).alias("attempts"), F.coalesce("n", F.lit(0)).alias("calls"))
