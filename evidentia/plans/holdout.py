"""What parts come to: shipped, asked about, refused; directly and from stored answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import holdout as ops
from .footprint import _CHOICE_SQL, _MORE_SQL, _rows
from .registry import Registry, Tables

REGISTRY = Registry()
query = REGISTRY.query
c = F.col

_BODY, _PITCH, _PINS = "coalesce(CASE WHEN body_length > 0 THEN body_length END, CASE WHEN body_width > 0 THEN body_width END, 3.0e0)", "coalesce(CASE WHEN pitch > 0 THEN pitch END, 0.5e0)", "coalesce(CASE WHEN pin_count > 0 THEN pin_count END, 8)"
_ANSWERS = {
    "pitch": _PITCH, "lead_sides": f"CASE WHEN {_PINS} % 4 = 0 AND {_PINS} >= 16 THEN 4 ELSE 2 END", "land_length": f"coalesce(CASE WHEN contact_max > 0 THEN contact_max END, greatest(0.4e0, least(1.0e0, {_PITCH} * 1.2e0)))",
    "land_width": f"greatest(0.2e0, {_PITCH} * 0.55e0)", "land_span": f"coalesce(CASE WHEN span_max > 0 THEN span_max END, {_BODY})", "lead_diameter": "0.5e0", "thermal_length": f"{_BODY} * 0.6e0", "thermal_width": f"{_BODY} * 0.6e0",
}
_OPEN = " + ".join(f"CASE WHEN {f} IS NULL THEN {1 << k} ELSE 0 END" for k, f in enumerate(_ANSWERS))
_TRIED = f"SELECT * EXCLUDE (p_partkey, mask, {', '.join(_ANSWERS)}), p_partkey * 256 + mask AS p_partkey, {', '.join(f'CASE WHEN mask & {1 << k} > 0 THEN {a} ELSE {f} END AS {f}' for k, (f, a) in enumerate(_ANSWERS.items()))} FROM ({_MORE_SQL}) r, (SELECT unnest(range(0, 256)) AS mask) m WHERE mask & ~({_OPEN}) = 0"
_NAMES = "[" + ", ".join(f"CASE WHEN mask & {1 << k} > 0 THEN '{f}' END" for k, f in enumerate(_ANSWERS)) + "]"


@query(f"""WITH t AS (SELECT p_partkey // 256 AS k, p_partkey % 256 AS mask, source FROM ({_CHOICE_SQL.replace(_MORE_SQL, _TRIED)})), d AS (SELECT k, source FROM t WHERE mask = 0),
b AS (SELECT k, mask, list_filter({_NAMES}, lambda x: x IS NOT NULL) AS asked FROM t JOIN d USING (k) WHERE d.source = 'ask' AND t.source IN ('printed', 'computed', 'through-hole') QUALIFY row_number() OVER (PARTITION BY k ORDER BY bit_count(mask), reverse(right(bin(256 + mask), 8)) DESC) = 1)
SELECT k AS p_partkey, source IN ('printed', 'computed', 'through-hole') AS ships, source IN ('printed', 'computed', 'through-hole') OR asked IS NOT NULL AS ships_answered, coalesce(len(asked), 0) AS asked,
CASE WHEN source IN ('printed', 'computed', 'through-hole') THEN '' WHEN asked IS NOT NULL THEN 'needs ' || array_to_string(asked, ',') WHEN source = 'ask' THEN 'unsupported' ELSE source END AS why FROM d LEFT JOIN b USING (k)""")
def ship_outcomes(t: Tables) -> DataFrame:
    """Whether each part ships, and for which fewest answers it would."""
    rows = _rows(t).drop("lead_span", "lead_contact", "lead_width", "lead_refused", "in_band", "printed")
    return ops.ship_outcomes(rows, "p_partkey")


_NUMBERS = ["pitch", "land_length", "land_width", "land_span", "land_span_cross", "thermal_length", "thermal_width", "body_length", "body_width", "lead_sides", "lead_diameter", "declared_leads", "formed_span", "formed_contact"]
_WORDS = {"lead_form": ["gullwing", "nolead", "straight"], "mounting": ["through-hole", "surface"], "outline_named": None, "outline_drawn": None}
_PAIRS = ["span", "contact", "lead_width"]
_STATUS = "CASE WHEN len(pins) = 0 THEN 'no-record' WHEN source IN ('printed', 'computed', 'through-hole') THEN 'ships' WHEN source = 'ask' AND needs <> '' THEN 'asks' ELSE 'refused' END"


@query(f"""SELECT p_partkey, status, CASE WHEN status = 'asks' THEN needs WHEN status = 'refused' THEN CASE WHEN source = 'ask' THEN 'no land pattern' ELSE source END ELSE '' END AS detail
FROM (SELECT p_partkey, source, needs, {_STATUS} AS status FROM ({_CHOICE_SQL}) JOIN (SELECT p_partkey, pins FROM ({_MORE_SQL})) USING (p_partkey))""")
def replay_outcomes(t: Tables) -> DataFrame:
    """What parts come to from stored answers: in a long table with stale and repeated answers, read back as records."""
    rows = _rows(t).select("p_partkey", "pins", "pin_count", "exposed_pad", "printed_mm", *_NUMBERS, *_WORDS, *(f"{f}_{e}" for f in _PAIRS for e in ("min", "max")))
    nothing = {"number": "double", "words": "string", "low": "double", "high": "double", "pins": "array<string>"}

    def answer(field: str, **values) -> F.Column:
        made = [values[n].cast(kind).alias(n) if n in values else F.lit(None).cast(kind).alias(n) for n, kind in nothing.items()]
        return F.struct(F.lit(field).alias("field"), *made)

    said = [*(answer(f, number=c(f)) for f in [*_NUMBERS, "pin_count"]), *(answer(f, words=c(f)) for f in _WORDS), *(answer(f, low=c(f"{f}_min"), high=c(f"{f}_max")) for f in _PAIRS), answer("pins", pins=c("pins"))]
    answers = rows.select("p_partkey", F.explode(F.array(*said)).alias("a")).select("p_partkey", "a.*").withColumn("fingerprint", F.sha2(F.concat_ws("|", "p_partkey", "field"), 256))
    now = answers.withColumn("stored_at", F.lit(2))
    stale = answers.withColumns({"stored_at": F.lit(1), "number": c("number") + 1, "words": F.lit("stale"), "low": c("high") * 9})
    latest = ops.latest_answers(now.union(stale.select(now.columns)).union(now), ["p_partkey", "field"])
    records = ops.record_from_answers(latest, "p_partkey", _NUMBERS, _WORDS, _PAIRS)
    return ops.replayed(records.join(rows.select("p_partkey", "exposed_pad", "printed_mm"), "p_partkey"), "p_partkey")
