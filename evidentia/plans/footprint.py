"""From records to footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import footprint as ops
from ..operators import geometry as pads_ops
from ..operators import sinks
from . import geometry as geometry_plans
from .geometry import REGISTRY as GEOMETRY
from .geometry import _PLACED_SQL, DUAL_SQL, RECORDS_SQL, _long, land_sql, placed, records
from .registry import Registry, Tables

REGISTRY = Registry()
query = REGISTRY.query
c = F.col

#: What a record has besides, for either engine: straight leads, what the assembler states, mounting, drawings named and seen.
_MORE = {
    "lead_form_": "case when p_partkey % 5 = 1 then 'straight' else lead_form end",
    "formed_span": "case when p_partkey % 15 = 1 then 0.0e0 when p_partkey % 10 = 1 then 3.5e0 + 0.02e0 * p_size end",
    "formed_contact": "case when p_partkey % 4 <> 3 then 0.6e0 end",
    "declared_leads": "case when p_partkey % 31 = 0 then 5 when p_partkey % 3 = 0 then pin_count end",
    "outline_named": "case when p_partkey % 4 = 0 then 'D' end",
    "outline_drawn": "case when p_partkey % 8 = 0 then 'DW' when p_partkey % 2 = 0 then 'D' end",
    "exposed_pad": "p_partkey % 6 = 0",
    "mounting": "case when p_partkey % 9 = 4 then 'through-hole' else 'surface' end",
    "lead_sides": "case p_partkey % 12 when 0 then null when 5 then 3 else 2 end",
    "lead_diameter": "case when p_partkey % 2 = 0 then 0.6e0 end",
    "printed_mm_": "case p_partkey % 7 when 0 then 1.5e0 when 1 then 0.0e0 else null end",
}
_MORE_SQL = f"SELECT * EXCLUDE (lead_form, lead_form_), lead_form_ AS lead_form FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _MORE.items())} FROM ({RECORDS_SQL}))"


def _rows(t: Tables) -> DataFrame:
    rows = records(t).selectExpr("*", *(f"{e} as {n}" for n, e in _MORE.items()))
    rows = rows.drop("lead_form").withColumnRenamed("lead_form_", "lead_form")
    printed = F.when(c("printed_mm_") > 0, F.array("printed_mm_", F.lit(0.4), F.lit(5.0))).when(c("printed_mm_") == 0, F.array(F.lit(99.0)))
    return ops.judged(rows.withColumn("printed_mm", printed), "formed_span", "formed_contact")


_OK = "{0}_min > 0 AND {0}_max >= {0}_min"
_LEAD_SQL = f"""SELECT * EXCLUDE (span_min, span_max, contact_min, contact_max, lead_width_min, lead_width_max), CASE WHEN keep THEN s0 END AS span_min, CASE WHEN keep THEN s1 END AS span_max, CASE WHEN keep THEN c0 END AS contact_min, CASE WHEN keep THEN c1 END AS contact_max,
 CASE WHEN keep THEN lead_width_min END AS lead_width_min, CASE WHEN keep THEN lead_width_max END AS lead_width_max FROM (SELECT *, whole AND NOT wide AS keep, whole AND wide AS lead_refused FROM (SELECT *, s0 IS NOT NULL AND c0 IS NOT NULL AND c1 IS NOT NULL AND coalesce({_OK.format('lead_width')}, false) AS whole, coalesce(pitch > 0 AND lead_width_max > 0.75e0 * pitch, false) AS wide
 FROM (SELECT *, CASE WHEN straight THEN CASE WHEN formed_span > 0 THEN formed_span END WHEN lead_form = 'gullwing' AND {_OK.format('span')} THEN span_min END AS s0, CASE WHEN straight THEN CASE WHEN formed_span > 0 THEN formed_span END WHEN lead_form = 'gullwing' AND {_OK.format('span')} THEN span_max END AS s1,
 CASE WHEN straight THEN CASE WHEN formed_contact > 0 THEN formed_contact END ELSE contact_min END AS c0, CASE WHEN straight THEN CASE WHEN formed_contact > 0 THEN formed_contact END ELSE contact_max END AS c1 FROM (SELECT *, lead_form = 'straight' AS straight FROM ({_MORE_SQL})))))"""
_LEVELS = _LEAD_SQL
for _v in "ACB":
    _LEVELS = f"SELECT * EXCLUDE (z, g, x, sound), CASE WHEN sound THEN z END AS z{_v}, CASE WHEN sound THEN g END AS g{_v}, CASE WHEN sound THEN x END AS x{_v} FROM ({land_sql(_v, _LEVELS)})"
_JUDGED_SQL = f"""SELECT *, CASE WHEN NOT coalesce(land_length > 0 AND land_width > 0 AND land_span > 0, false) THEN 'none' WHEN land_span - land_length <= 0 THEN 'rows meet' WHEN NOT coalesce(band, true) THEN 'outside the band'
 WHEN coalesce(pitch > 0 AND land_width >= pitch, false) THEN 'lands touch' WHEN land_span_cross IS NOT NULL AND (land_span_cross <= 0 OR land_span_cross - land_length <= 0) THEN 'cross rows meet' ELSE 'ok' END AS printed
 FROM (SELECT *, CASE WHEN zA IS NOT NULL AND zC IS NOT NULL THEN land_span + land_length >= zC - 0.01e0 AND land_span + land_length <= zA + 0.01e0 END AS band FROM ({_LEVELS}))"""


@query(f"SELECT p_partkey, span_min AS span_low, span_max AS span_high, contact_min AS contact_low, lead_width_max AS width_high, lead_refused FROM ({_LEAD_SQL})")
def lead_from_drawing(t: Tables) -> DataFrame:
    """The seated lead of each part: drawn, or formed by the assembler, or none."""
    return _rows(t).select("p_partkey", c("lead_span.low").alias("span_low"), c("lead_span.high").alias("span_high"), c("lead_contact.low").alias("contact_low"), c("lead_width.high").alias("width_high"), "lead_refused")


@query(f"SELECT p_partkey, band AS in_band, printed FROM ({_JUDGED_SQL})")
def printed_land_gate(t: Tables) -> DataFrame:
    return _rows(t).select("p_partkey", "in_band", "printed")


_FAR = "len(list_filter(mm, lambda p: abs(p - {0}) <= 0.12e0)) = 0"
_LIST = lambda *pairs: f"concat_ws(',', {', '.join(f'CASE WHEN {test} THEN {name!r} END' for test, name in pairs)})"
_CHOICE_SQL = f"""SELECT p_partkey, source, CASE WHEN source <> 'ask' THEN '' WHEN thermal THEN {_LIST(('thermal_length IS NULL', 'pad length'), ('thermal_width IS NULL', 'pad width'))} WHEN mounting = 'through-hole' THEN hole ELSE
 {_LIST(('pitch IS NULL', 'pitch'), ('lead_sides IS NULL', 'sides'), ('land_length IS NULL', 'land length'), ('land_width IS NULL', 'land width'), ('land_span IS NULL', 'land span'))} END AS needs
FROM (SELECT *, CASE WHEN coalesce(declared_leads <> pin_count, false) THEN 'refused: other package' WHEN coalesce(outline_named <> outline_drawn, false) THEN 'refused: other drawing' WHEN thermal THEN 'ask' WHEN mounting = 'through-hole' THEN CASE WHEN hole = '' THEN 'through-hole' ELSE 'ask' END
 WHEN printed = 'ok' AND layout THEN 'printed' WHEN zB IS NOT NULL AND layout AND NOT (len(mm) > 0 AND ({_FAR.format('(zB - gB) / 2')} OR {_FAR.format('xB')} OR {_FAR.format('(zB + gB) / 2')})) THEN 'computed' ELSE 'ask' END AS source
FROM (SELECT *, exposed_pad AND (thermal_length IS NULL OR thermal_width IS NULL) AS thermal, coalesce(pitch > 0 AND lead_sides IN (1, 2, 4), false) AS layout, CASE WHEN printed_mm_ > 0 THEN [printed_mm_, 0.4e0, 5.0e0] WHEN printed_mm_ = 0 THEN [99.0e0] ELSE []::DOUBLE[] END AS mm,
 {_LIST(('lead_sides IS NULL OR lead_sides NOT IN (1, 2)', 'rows'), ('lead_diameter IS NULL', 'lead diameter'), ('lead_sides = 2 AND land_span IS NULL', 'row spacing'), ('pitch IS NULL', 'pitch'))} AS hole FROM ({_JUDGED_SQL})))"""


@query(_CHOICE_SQL)
def footprint_choice(t: Tables) -> DataFrame:
    """Where each part's footprint comes from: refused, printed, computed, through-hole, or what has to be asked."""
    return ops.chosen(_rows(t), "p_partkey").select("p_partkey", "source", F.array_join("needs", ",").alias("needs"))


@query(f"""SELECT p_partkey, concat_ws(',', CASE WHEN {_FAR.format('(zB - gB) / 2')} THEN 'length' END, CASE WHEN {_FAR.format('xB')} THEN 'width' END) AS far FROM (SELECT *, [1.5e0, 0.4e0] AS mm FROM ({_LEVELS}) WHERE zB IS NOT NULL)""")
def land_disagreement(t: Tables) -> DataFrame:
    """Computed lands against two numbers on a page."""
    rows = ops.with_pattern(_rows(t), "land", "B")
    far = ops.disagreements(F.array(F.lit(1.5), F.lit(0.4)), {"length": c("land.pad_length"), "width": c("land.x")})
    return rows.where("land is not null").select("p_partkey", F.array_join(far, ",").alias("far"))


_VACANT = "SELECT p_partkey, cast(5 + 2 * (p_size % 4) as int) as n, 0.5e0 as pitch, 2.0e0 as centre, cast(1 + p_partkey % (3 + p_size % 4) as int) as vacant FROM part"


@query(f"""SELECT p_partkey, number, CASE WHEN number <= s THEN -centre ELSE centre END AS x, -(s - 1) * pitch / 2 + (CASE WHEN number <= s THEN number - 1 ELSE s - (number - s + CASE WHEN number - s >= vacant THEN 1 ELSE 0 END) END) * pitch AS y
FROM (SELECT *, (n + 1) // 2 AS s, unnest(range(1, n + 1)) AS number FROM ({_VACANT}))""")
def pads_vacant(t: Tables) -> DataFrame:
    """Two rows of which one has an empty place."""
    return _long(ops.vacant_pads(t.spark.sql(_VACANT.replace("FROM part", "FROM {p}"), p=t.part), "p_partkey"))


@query("""WITH p AS (SELECT p_partkey, [2 + p_size % 3, p_size % 2, 3, 1]::INTEGER[] AS sides FROM part), s AS (SELECT p_partkey, sides, unnest(range(0, 4)) AS side FROM p), n AS (SELECT p_partkey, side, sides[side + 1] AS cnt, coalesce(list_sum(sides[1:side]), 0) AS before, unnest(range(1, sides[side + 1] + 1)) AS nth FROM s)
SELECT p_partkey, (before + nth)::BIGINT AS number, side::INTEGER AS side, (nth - (cnt + 1) / 2) * 0.5e0 * CASE WHEN side < 2 THEN 1 ELSE -1 END AS along FROM n""")
def pads_by_side(t: Tables) -> DataFrame:
    """Four sides with different numbers of leads, an empty one among them."""
    sides = F.expr("array(cast(2 + p_size % 3 as int), cast(p_size % 2 as int), 3, 1)")
    return _long(ops.sided_pads(t.part.select("p_partkey", sides.alias("sides"), F.lit(0.5).alias("pitch")), "p_partkey"))


@query("SELECT p_partkey, number, (number - 1 - (n - 1) / 2) * 2.54e0 AS x, 0.0e0 AS y, 0.6e0 + 0.2e0 AS drill, 0.6e0 + 0.2e0 + 2 * 0.4e0 AS pad FROM (SELECT p_partkey, 2 + p_size % 6 AS n, unnest(range(1, 3 + p_size % 6)) AS number FROM part)")
def through_hole_pads(t: Tables) -> DataFrame:
    """A single row of plated holes sized from the lead."""
    parts = t.part.select("p_partkey", (2 + c("p_size") % 6).cast("int").alias("n"), F.lit(2.54).alias("pitch"), G.through_hole(F.lit(0.6), "B").alias("h"))
    rows = _long(pads_ops.pads(parts.withColumn("pad_width", c("h.pad")).withColumn("pad_length", c("h.drill")), "p_partkey", "single"))
    return rows.select("p_partkey", "number", "x", "y", c("h").alias("drill"), c("w").alias("pad"))


_SHIFTED = f"SELECT p_partkey, number, x, y + CASE WHEN p_partkey % 19 = 0 AND number = 3 THEN 0.03e0 ELSE 0.0e0 END AS y, pitch FROM ({DUAL_SQL}) JOIN (SELECT p_partkey, pitch FROM ({_PLACED_SQL})) USING (p_partkey)".replace("AS cross,", 'AS "cross",')


@query(f"""WITH l AS (SELECT *, sum(new) OVER (PARTITION BY p_partkey ORDER BY x) AS line FROM (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY p_partkey ORDER BY x) > 0.005e0 THEN 1 ELSE 0 END AS new FROM ({_SHIFTED}))),
g AS (SELECT p_partkey, pitch, y - lag(y) OVER (PARTITION BY p_partkey, line ORDER BY y) AS gap FROM l) SELECT p_partkey, count(*) AS gaps, count(*) FILTER (abs(gap - round(gap / pitch) * pitch) > 0.005e0 OR round(gap / pitch) < 1) AS breaks FROM g WHERE gap IS NOT NULL GROUP BY p_partkey""")
def pitch_multiples(t: Tables) -> DataFrame:
    """Rows of lands found by their coordinate, and gaps that are no whole pitches; some lands were moved."""
    pads = _long(pads_ops.pads(placed(t), "p_partkey", "dual")).join(placed(t).select("p_partkey", "pitch"), "p_partkey")
    moved = F.when((c("p_partkey") % 19 == 0) & (c("number") == 3), 0.03).otherwise(0.0)
    return ops.pitch_breaks(pads.withColumn("y", c("y") + moved), "p_partkey", "x", "y", "pitch")


@query("SELECT p_partkey, CASE WHEN u >= -2147483648 AND u < 2147483648 THEN u::BIGINT END AS units FROM (SELECT p_partkey, round(mm / 0.0254e0 * 10000) AS u FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 9000.0e0 ELSE -5 + 0.37e0 * p_size END AS mm FROM part))")
def unit_conversions(t: Tables) -> DataFrame:
    mm = F.expr("case when p_partkey % 11 = 0 then 9000.0e0 else -5 + 0.37e0 * p_size end")
    return t.part.select("p_partkey", ops.altium_units(mm).alias("units"))


@query(" UNION ALL ".join(f"SELECT p_partkey, '{v}' AS level, z / 2 + {G.COURTYARD[v]!r}e0 AS half, least(1.0e0, 0.25e0 * least(body_width, body_length)) AS chamfer FROM ({land_sql(v, RECORDS_SQL)}) WHERE sound" for v in "ABC"))
def courtyards(t: Tables) -> DataFrame:
    """Half the courtyard along the span at each density, and the chamfer of the body's outline."""
    span, contact, width = ((c(f"{n}_min"), c(f"{n}_max")) for n in ("span", "contact", "lead_width"))
    options = F.array(*(F.struct(F.lit(v).alias("level"), ops.courtyard_half(G.land_pattern(span, contact, width, v)["z"], v).alias("half")) for v in "ABC"))
    rows = records(t).select("p_partkey", ops.fab_chamfer(c("body_width"), c("body_length")).alias("chamfer"), F.explode(options).alias("o"))
    return rows.where("o.half is not null").select("p_partkey", "o.level", "o.half", "chamfer")


@query(f"""SELECT p_partkey, count(*) AS pads, count(*) = any_value(n) AND abs(max(x) - min(x) - 2 * any_value(centre)) <= 0.005e0 AND abs(max(w) - any_value(pad_length)) <= 0.005e0 AND abs(max(h) - any_value(pad_width)) <= 0.005e0 AS agrees
FROM (SELECT p.*, n, centre, pad_length, pad_width FROM (SELECT p_partkey, number, x + CASE WHEN p_partkey % 23 = 0 AND number = 1 THEN 0.5e0 ELSE 0.0e0 END AS x, w, h FROM ({DUAL_SQL}) WHERE NOT (p_partkey % 29 = 0 AND number = 2)) p JOIN ({_PLACED_SQL}) q USING (p_partkey)) GROUP BY p_partkey""".replace("AS cross,", 'AS "cross",'))
def copper_check(t: Tables) -> DataFrame:
    """Emitted lands against their records; some lands were lost or moved."""
    pads = _long(pads_ops.pads(placed(t), "p_partkey", "dual")).where("not (p_partkey % 29 = 0 and number = 2)")
    pads = pads.withColumn("x", c("x") + F.when((c("p_partkey") % 23 == 0) & (c("number") == 1), 0.5).otherwise(0.0))
    return ops.copper_check(pads, placed(t), "p_partkey")


_EDGES = "SELECT p_partkey, unnest([1, 2]) AS edge, unnest([-1.9e0, 1.9e0]) AS ex, -3.0e0 AS low, 3.0e0 AS high FROM part"


@query(f"""WITH c AS (SELECT e.p_partkey, e.edge, greatest(low, y - h / 2 - 0.1e0) AS a, least(high, y + h / 2 + 0.1e0) AS b FROM ({_EDGES}) e JOIN ({DUAL_SQL}) p ON e.p_partkey = p.p_partkey AND x - w / 2 - 0.1e0 < ex AND ex < x + w / 2 + 0.1e0 AND y - h / 2 - 0.1e0 < high AND y + h / 2 + 0.1e0 > low),
m AS (SELECT p_partkey, edge, a, b FROM c UNION ALL SELECT p_partkey, edge, high, high FROM ({_EDGES})), w AS (SELECT *, coalesce(max(b) OVER (PARTITION BY p_partkey, edge ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -3.0e0) AS at_ FROM m)
SELECT p_partkey, edge::INTEGER AS edge, at_ AS start, a AS "end" FROM w WHERE a > at_""".replace("AS cross,", 'AS "cross",'))
def silk_segments(t: Tables) -> DataFrame:
    """What is drawn of a body's long edges between its lands."""
    edges = t.part.repartition("p_partkey").select("p_partkey", F.explode(F.array(F.struct(F.lit(1).alias("edge"), F.lit(-1.9).alias("x")), F.struct(F.lit(2).alias("edge"), F.lit(1.9).alias("x")))).alias("e"))
    edges = edges.select("p_partkey", "e.edge", "e.x", F.lit(-3.0).alias("low"), F.lit(3.0).alias("high"))
    return ops.silk(edges, pads_ops.pads(placed(t), "p_partkey", "dual"), "p_partkey", 0.1)


_PLATED = "SELECT p_partkey, n, number, number * 2.0e0 AS x, 0.0e0 AS y, 1.0e0 AS w, 1.0e0 AS h, p_partkey % 3 = 0 AS plated, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 0.5e0 END AS drill, CASE WHEN p_partkey % 5 = 0 AND number = 1 THEN 0.3e0 ELSE 0.0e0 END AS px FROM (SELECT p_partkey, 2 + p_size % 3 AS n, unnest(range(1, 3 + p_size % 3)) AS number FROM part)"


@query(f"""WITH p AS ({_PLATED}) SELECT p_partkey, kind, count(*) AS n FROM (SELECT p_partkey, 'unplaced-pin' AS kind FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'land-count' FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 'paste-on-hole' FROM p WHERE plated UNION ALL SELECT p_partkey, 'paste-past-copper' FROM p WHERE abs(px) + 0.8e0 / 2 > 0.5e0 + 1e-6 UNION ALL SELECT p_partkey, 'no-drill' FROM p WHERE plated AND drill IS NULL) GROUP BY ALL""")
def paste_and_hole_rules(t: Tables) -> DataFrame:
    """The rules for paste, holes, the pad under the part and pins without a land, on lands with defects."""
    parts = t.part.select("p_partkey", (2 + c("p_size") % 3).cast("int").alias("n"), F.lit(99.0).alias("half_width"), F.lit(99.0).alias("half_height"), F.lit(2.0).alias("mx"), F.lit(0.0).alias("my"), (c("p_partkey") % 4 == 0).alias("exposed"),
                          F.when(c("p_partkey") % 7 == 0, F.array(F.lit("1"), F.lit("77"), F.lit("EP"))).otherwise(F.array(F.lit("1"), F.lit("2"))).alias("pins"))
    lands = parts.repartition("p_partkey").select("p_partkey", F.explode(F.sequence(F.lit(1), "n")).alias("number"))
    moved = c("number") * 2.0 + F.when((c("p_partkey") % 5 == 0) & (c("number") == 1), 0.3).otherwise(0.0)
    paste = F.array(F.struct(moved.alias("x"), F.lit(0.0).alias("y"), F.lit(0.8).alias("w"), F.lit(0.8).alias("h")))
    lands = lands.select("p_partkey", "number", (c("number") * 2.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"), (c("p_partkey") % 3 == 0).alias("plated"), F.when(c("p_partkey") % 6 != 0, 0.5).alias("drill"), paste.alias("paste"))
    return pads_ops.violations(parts, lands, "p_partkey")


_BOX = "printf('  (fp_rect (start %.3f %.3f) (end %.3f %.3f) (layer \"{0}\"))', -{1}, -{2}, {1}, {2})"
_SILK_SQL = REGISTRY.sql["silk_segments"]
_NAME = r"""regexp_replace(p_name, '(["\\])', '\\\1', 'g')"""


@query(rf"""WITH s AS ({_SILK_SQL}), l AS (SELECT p_partkey, string_agg(printf('  (fp_line (start %.3f %.3f) (end %.3f %.3f) (layer "F.SilkS"))', x, start, x, "end"), chr(10) ORDER BY x, start) AS silk FROM (SELECT *, CASE WHEN edge = 1 THEN -1.9e0 ELSE 1.9e0 END AS x FROM s) GROUP BY p_partkey),
p AS (SELECT p_partkey, string_agg(printf('  (pad "%d" smd rect (at %.3f %.3f) (size %.3f %.3f) (layers "F.Cu" "F.Paste" "F.Mask"))', number, x, y, w, h), chr(10) ORDER BY number) AS pads FROM ({DUAL_SQL}) GROUP BY p_partkey)
SELECT p_partkey, '(footprint "' || {_NAME} || '"' || chr(10) || '  (layer "F.Cu")' || chr(10) || {_BOX.format('F.CrtYd', 'half_width', 'half_height')} || chr(10) || {_BOX.format('F.Fab', '1.5e0', '2.0e0')} || chr(10) || coalesce(silk || chr(10), '') || pads || chr(10) || '  (model "' || {_NAME} || '.step"))' AS body
FROM ({_PLACED_SQL}) JOIN p USING (p_partkey) LEFT JOIN l USING (p_partkey) JOIN (SELECT p_partkey, p_name FROM part) USING (p_partkey)""".replace("AS cross,", 'AS "cross",'))
def footprint_files(t: Tables) -> DataFrame:
    """Whole footprint files."""
    parts = placed(t, "p_name").withColumn("body_width", F.lit(3.0)).withColumn("body_length", F.lit(4.0))
    lines = silk_segments(t).withColumn("x", F.when(c("edge") == 1, -1.9).otherwise(1.9))
    pads = pads_ops.pads(placed(t), "p_partkey", "dual").withColumn("drill", F.lit(None).cast("double"))
    return sinks.footprint_file(parts, pads, lines, "p_partkey", "p_name")


_BODY_SQL, _SYMBOL_SQL = (GEOMETRY.sql[n] for n in ("footprint_text", "symbol_text"))


@query(f"""WITH f AS (SELECT p_partkey, 'footprint.kicad_mod' AS path, body FROM ({_BODY_SQL}) UNION ALL SELECT p_partkey, 'symbol.kicad_sym', body FROM ({_SYMBOL_SQL}))
SELECT p_partkey, '{{"version":1,"files":[' || string_agg('{{"path":"' || path || '","bytes":' || octet_length(body::BLOB) || ',"sha256":"' || sha256(body) || '"}}', ',' ORDER BY path) || ']}}' AS manifest FROM f GROUP BY p_partkey""")
def export_bundles(t: Tables) -> DataFrame:
    """Manifests of the files of every part that has any."""
    files = geometry_plans.footprint_text(t).select("p_partkey", F.lit("footprint.kicad_mod").alias("path"), "body")
    files = files.union(geometry_plans.symbol_text(t).select("p_partkey", F.lit("symbol.kicad_sym").alias("path"), "body"))
    return sinks.bundle(files, "p_partkey", "path", "body")


_LE = "(SELECT substr(hx, 7, 2) || substr(hx, 5, 2) || substr(hx, 3, 2) || substr(hx, 1, 2) FROM (SELECT printf('%08X', (round({0} / 0.0254e0 * 10000))::BIGINT & 4294967295) AS hx))"


@query(f"""SELECT p_partkey, string_agg(printf('%02X', 18 + length(number::VARCHAR)) || '000000' || '01' || {_LE.format('x')} || {_LE.format('y')} || {_LE.format('w')} || {_LE.format('h')} || printf('%02X', length(number::VARCHAR)) || hex(number::VARCHAR), '' ORDER BY number) AS hex FROM ({DUAL_SQL}) GROUP BY p_partkey""")
def altium_pad_records(t: Tables) -> DataFrame:
    """Lands as binary records, in hex."""
    return sinks.pad_records(pads_ops.pads(placed(t), "p_partkey", "dual"), "p_partkey")
