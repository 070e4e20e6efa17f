"""What comes in and what is told about it: uploads, references, failures, names, ranges, log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as T
from ..operators import sinks, text
from ..sources import tables as S
from .registry import Registry, Tables

REGISTRY = Registry()
query = REGISTRY.query
c = F.col

_UPLOAD = "case page_id % 5 when 0 then '%PDF-1.7 ' || html when 1 then html when 2 then '%PDF-' when 3 then '%PDF-1.4 ' || repeat('é', 40) end"


def _uploads(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.encode(F.expr(_UPLOAD), "UTF-8").alias("content"))


@query(f"SELECT page_id, CASE WHEN x IS NULL THEN 'missing' WHEN strlen(x) < 64 THEN 'too_small' WHEN NOT starts_with(x, '%PDF-') THEN 'no_magic' END AS rejected FROM (SELECT page_id, {_UPLOAD} AS x FROM pages)")
def upload_checks(t: Tables) -> DataFrame:
    """Which uploads can't be documents, by their bytes."""
    return _uploads(t).select("page_id", S.byte_verdict("content").alias("rejected"))


@query(f"""SELECT page_id, 'Data-sheet_' || page_id || '.pdf' AS file_name, sha256(x) AS sha256, strlen(x)::INTEGER AS byte_length FROM (SELECT page_id, {_UPLOAD} AS x FROM pages) WHERE strlen(x) >= 64 AND starts_with(x, '%PDF-')""")
def content_references(t: Tables) -> DataFrame:
    """References to the uploads that were taken: a safe name, the bytes' hash and number."""
    named = _uploads(t).withColumn("name", F.concat(F.lit("C:\\docs/up/ -Data sheet_"), c("page_id").cast("string"), F.lit(" .PDF")))
    return S.content_reference(named.where(S.byte_verdict("content").isNull()), "name", "content").select("page_id", "file_name", "sha256", "byte_length")


_NAME = "case p_partkey % 4 when 0 then ' Vdd ‐ in ' || cast(p_size as string) when 1 then 'out−' || chr(9) || 'b' when 2 then 'a–b—c' else null end"


@query(f"SELECT p_partkey, regexp_replace(translate(upper(n), '‐‑‒–—−', '------'), '[ \\t\\r\\n]+', '', 'g') AS pin, regexp_replace(lower(n), '[ \\t\\r\\n]+', '', 'g') AS folded FROM (SELECT p_partkey, {_NAME.replace('as string', 'as varchar')} AS n FROM part)")
def names_folded(t: Tables) -> DataFrame:
    """Names of pins with all dashes alike and without blanks, and texts as they are compared."""
    rows = t.part.selectExpr("p_partkey", f"{_NAME} as n")
    return rows.select("p_partkey", T.pin_name_fold(c("n")).alias("pin"), T.space_fold(c("n")).alias("folded"))


#: A failure's message and what it is, by hand: one for each rule, and some that several rules fit.
_FAILURES = [
    ("Spending cap reached (HTTP 429)", "cap"), ("your credit balance is too low", "credits"), ("Quota exceeded: requests per day", "daily"), ("429 Too Many Requests", "unnamed"),
    ("connect ETIMEDOUT: timed out", "transient"), ("HTTP 503 Service Unavailable", "transient"), ("invalid argument", "permanent"), ("", "permanent"),
]
_MESSAGE = "case " + " ".join(f"when event_id % {len(_FAILURES)} = {k} then '{m}'" for k, (m, _) in enumerate(_FAILURES)) + " end"


@query("SELECT event_id, CASE " + " ".join(f"WHEN event_id % {len(_FAILURES)} = {k} THEN '{kind}'" for k, (_, kind) in enumerate(_FAILURES)) + " END AS kind FROM events")
def failure_kinds(t: Tables) -> DataFrame:
    """Why calls failed."""
    return t.events.select("event_id", T.failure_kind(F.expr(_MESSAGE)).alias("kind"))


_LOW = "case p_partkey % 6 when 0 then '0.3' when 1 then '-1' when 2 then 'x' when 3 then '2' when 4 then 'NaN' else null end"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 3) AND 1.0 + p_size / 100 >= CASE p_partkey % 6 WHEN 0 THEN 0.3 ELSE 2 END THEN CASE p_partkey % 6 WHEN 0 THEN 0.3e0 ELSE 2e0 END END AS low, CASE WHEN p_partkey % 6 = 0 THEN round(1.0 + p_size / 100, 2)::DOUBLE END AS high FROM part")
def ranges_coerced(t: Tables) -> DataFrame:
    """Pairs of numbers as texts: both positive and in order, or nothing."""
    high = F.round(1.0 + c("p_size") / 100, 2).cast("string")
    r = t.part.select("p_partkey", J.positive_range(F.expr(_LOW), high).alias("r"))
    return r.select("p_partkey", "r.low", "r.high")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"event_id":' || event_id || ',"event_type":"' || event_type || '","part":"P' || event_id || '"}' ELSE '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' END AS line FROM events""")
def log_lines(t: Tables) -> DataFrame:
    """Log lines without secrets, and with the part only where that is allowed."""
    rows = t.events.select("event_id", "event_type", F.lit("sesame").alias("Api_Key"), F.concat(F.lit("P"), c("event_id").cast("string")).alias("part"))
    lines = lambda allowed: sinks.scrubbed(rows.where(c("event_id") % 2 == (0 if allowed else 1)), ["api_key"], "part", allowed)
    both = lines(True).union(lines(False))
    return both.select(F.get_json_object("line", "$.event_id").cast("long").alias("event_id"), "line")


#: A pinout, and the letters of a font that shows each 29 characters lower.
_PINS = ["VCC", "GND", "OUTA", "INB", "VDD", "RESET", "CLK"]
_ITEM = "case p_partkey % 7 " + " ".join(f"when {k} then '{n}'" for k, n in enumerate(_PINS)) + " end"
_LETTERS = "".join(map(chr, range(65, 91)))


@query(f"SELECT p_partkey, {_ITEM} AS str FROM part")
def fonts_decoded(t: Tables) -> DataFrame:
    """Items of figures in a shifted font, decoded font by font; those of readable fonts stay."""
    shifted = c("p_partkey") % 40 < 20
    items = t.part.select("p_partkey", (c("p_partkey") / 40).cast("long").alias("doc"), F.when(shifted, "F1").otherwise("F2").alias("font"), F.when(shifted, F.translate(F.expr(_ITEM), _LETTERS, "".join(chr(ord(x) - 29) for x in _LETTERS))).otherwise(F.expr(_ITEM)).alias("str"))
    return text.shifted_fonts_decoded(items, ["doc"], "font", "p_partkey", "str").select("p_partkey", "str")
