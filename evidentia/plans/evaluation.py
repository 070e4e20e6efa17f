"""Scoreboards over documents, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as ops
from .evidence import MERGED_SQL, merged
from .geometry import _STATE, RECORDS_SQL, records
from .registry import Registry, Tables

REGISTRY = Registry()
query = REGISTRY.query


@query("""SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) AS n, count(*) FILTER (quality IS NOT NULL) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic,
count(*) FILTER (quality IS NOT NULL) / count(*) AS labelled_share, count(*) FILTER (quality = 1) / count(*) AS good_share, count(*) FILTER (toxic = 1) / count(*) AS toxic_share FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY ROLLUP (source)""")
def category_rollup(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source").join(t.labels.withColumnRenamed("toxic", "is_toxic"), "doc_id", "left")
    flags = {"labelled": F.col("quality").isNotNull(), "good": F.col("quality") == 1, "toxic": F.col("is_toxic") == 1}
    return ops.rates(rows, "source", flags)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS largest FROM events GROUP BY event_type")
def latency_percentiles(t: Tables) -> DataFrame:
    return ops.percentiles(t.events, ["event_type"], "value", [0.5, 0.95, 0.99])


@query("SELECT o_orderpriority, o_totalprice AS upper_median FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE k = n // 2")
def upper_median(t: Tables) -> DataFrame:
    return ops.upper_median(t.orders, ["o_orderpriority"], "o_totalprice")


_REASON = "case when n_chars < 200 then 'too short' when text like '%|%' then 'table' when lang <> 'en' then 'language ' || lang end"


@query(f"""SELECT reason, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (k <= 5) AS first FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS k FROM (SELECT doc_id, {_REASON} AS reason FROM documents) WHERE reason IS NOT NULL) GROUP BY reason""")
def reason_lists(t: Tables) -> DataFrame:
    return ops.reason_lists(t.documents.selectExpr("doc_id", f"{_REASON} as reason").where("reason is not null"), "reason", "doc_id")


_TRUTH = "case when p_partkey % 15 = 0 then null else {0} + (case when p_partkey % 6 = 0 then 0.05e0 when p_partkey % 6 = 1 then 0.004e0 else 0.0e0 end) end"


@query(f"""WITH r AS (SELECT p_partkey, land_length AS value, {_TRUTH.format('land_length')} AS truth, p_partkey % 30 = 0 AS asserts FROM ({RECORDS_SQL}))
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN truth IS NULL AND asserts THEN CASE WHEN value IS NULL THEN 'correct' ELSE 'WRONG' END WHEN truth IS NULL THEN 'silent' WHEN value IS NULL THEN 'not read' WHEN abs(value - truth) <= 0.005e0 THEN 'correct' ELSE 'WRONG' END AS verdict
FROM (SELECT CASE WHEN p_partkey % 9 = 0 AND p_partkey % 2 = 0 THEN NULL ELSE value END AS value, CASE WHEN value IS NULL AND p_partkey % 18 = 9 THEN 1.5e0 ELSE truth END AS truth, asserts FROM r)) GROUP BY verdict""")
def oracle_tolerance(t: Tables) -> DataFrame:
    """Readings of one dimension against the truth, by verdict; some truths say that nothing is printed."""
    rows = records(t).selectExpr("p_partkey", "land_length as value", f"{_TRUTH.format('land_length')} as truth", "p_partkey % 30 = 0 as asserts")
    oracle = rows.selectExpr("p_partkey", "case when value is null and p_partkey % 18 = 9 then 1.5e0 else truth end as truth", "asserts")
    readings = rows.where("value is not null and not (p_partkey % 9 = 0 and p_partkey % 2 = 0)").select("p_partkey", "value")
    return ops.against_oracle(readings, oracle, ["p_partkey"], "value", "truth", "asserts").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


_HALF = "SELECT o_custkey, count(*) AS orders FROM orders WHERE o_orderkey % 2 = {0} GROUP BY o_custkey"


@query(f"""SELECT o_custkey, CASE WHEN a.o_custkey IS NULL THEN '(absent)' ELSE coalesce(a.orders::VARCHAR, '(null)') END AS before, CASE WHEN b.o_custkey IS NULL THEN '(absent)' ELSE coalesce(b.orders::VARCHAR, '(null)') END AS after
FROM ({_HALF.format(0)}) a FULL OUTER JOIN ({_HALF.format(1)}) b USING (o_custkey) WHERE a.orders IS DISTINCT FROM b.orders OR a.o_custkey IS NULL OR b.o_custkey IS NULL""")
def run_diff(t: Tables) -> DataFrame:
    before, after = (t.orders.where(f"o_orderkey % 2 = {k}").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders")) for k in (0, 1))
    return ops.run_diff(before, after, ["o_custkey"], "orders")


@query("""SELECT event_type, count(*) AS calls, count(*) FILTER (paid) AS paid_calls, (coalesce(sum(i) FILTER (paid), 0) * 0.3e0 / 1e6 + coalesce(sum(o) FILTER (paid), 0) * 2.5e0 / 1e6) AS usd
FROM (SELECT event_type, event_id % 2000 AS i, event_id % 300 AS o, event_id % 4 <> 0 AS paid FROM events) GROUP BY event_type""")
def spend_by_kind(t: Tables) -> DataFrame:
    """What calls of each kind cost: tokens are summed as whole numbers and priced once."""
    from ..functions.text import usd

    calls = t.events.selectExpr("event_type", "event_id % 2000 as i", "event_id % 300 as o", "event_id % 4 <> 0 as paid")
    sums = calls.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.count_if("paid").alias("paid_calls"), *(F.coalesce(F.sum(F.when(F.col("paid"), F.col(c))), F.lit(0)).alias(c) for c in "io"))
    return sums.select("event_type", "calls", "paid_calls", usd(F.col("i"), F.col("o")).alias("usd"))


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (event_id % 4 <> 0) AS paid_calls, round(100 * sum(0.0003e0 + 0.0025e0) FILTER (event_id % 4 <> 0), 3) AS usd_100, round(0.0028e0 * 500 * 100, 3) AS projected_100 FROM events GROUP BY event_type")
def spend_projection(t: Tables) -> DataFrame:
    """Calls of equal size, and what 500 more would cost, in hundredths to be compared beyond the last digits of sums."""
    calls = t.events.select("event_type", "event_id", F.lit(1000).alias("i"), F.lit(1000).alias("o"))
    out = ops.spend(calls, ["event_type"], "i", "o", F.col("event_id") % 4 != 0, 500)
    return out.select("event_type", "calls", "paid_calls", F.round(F.col("usd") * 100, 3).alias("usd_100"), F.round(F.col("projected") * 100, 3).alias("projected_100"))


@query(f"""WITH r AS (SELECT *, CASE WHEN value IS NOT NULL AND method LIKE 'vlm%' AND citation IS NULL THEN 'unverifiable' WHEN method = 'vlm-drawing' THEN 'read-from-image' WHEN method LIKE 'vlm%' AND coalesce(confidence, 0) <= 0.5e0 THEN 'model-read' END AS reason FROM ({MERGED_SQL}))
SELECT k, f, reason, f = 4 AS blocking, row_number() OVER (PARTITION BY k ORDER BY f = 4 DESC, f) AS place FROM r WHERE reason IS NOT NULL""")
def review_queue(t: Tables) -> DataFrame:
    out = ops.review_queue(merged(t), "k", "f", "f", F.col("f") == 4)
    return out.withColumn("place", F.col("place").cast("long"))


@query(f"""SELECT status, coalesce(array_to_string(list_sort(needs), ','), '') AS needs, count(*) AS n FROM (SELECT CASE WHEN lead_form = 'nolead' THEN 'unsupported' WHEN len(needs) > 0 THEN 'needs-input' ELSE 'ships' END AS status, CASE WHEN lead_form = 'nolead' THEN [] ELSE needs END AS needs
FROM (SELECT lead_form, list_filter([CASE WHEN pitch IS NULL THEN 'pitch' END, CASE WHEN body_width IS NULL OR body_length IS NULL THEN 'body' END, CASE WHEN land_length IS NULL AND contact_min IS NULL THEN 'land' END], lambda x: x IS NOT NULL) AS needs FROM ({RECORDS_SQL}))) GROUP BY ALL""")
def package_options(t: Tables) -> DataFrame:
    """For every package: does it ship, what would have to be asked, or is its form unsupported."""
    c = F.col
    asks = [F.when(c("pitch").isNull(), "pitch"), F.when(c("body_width").isNull() | c("body_length").isNull(), "body"), F.when(c("land_length").isNull() & c("contact_min").isNull(), "land")]
    needs = F.array_sort(F.array_compact(F.array(*asks)))
    unsupported = c("lead_form") == "nolead"
    rows = records(t).select(F.when(unsupported, F.array().cast("array<string>")).otherwise(needs).alias("needs"), unsupported.alias("u"))
    status = F.when(c("u"), "unsupported").when(F.size("needs") > 0, "needs-input").otherwise("ships")
    return rows.groupBy(status.alias("status"), F.array_join("needs", ",").alias("needs")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, 0) + coalesce(b, 0) END AS tokens FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id END AS a, CASE WHEN event_id % 3 = 0 THEN user_id END AS b FROM events)")
def usage_merged(t: Tables) -> DataFrame:
    a, b = F.when(F.col("event_id") % 2 == 0, F.col("event_id")), F.when(F.col("event_id") % 3 == 0, F.col("user_id"))
    return t.events.select("event_id", ops.usage_merged(a, b).alias("tokens"))


@query("SELECT user_id, CASE WHEN count(DISTINCT k) = 1 THEN min(k) END AS kind FROM (SELECT user_id, CASE WHEN event_type IN ('error', 'signup') THEN event_type END AS k FROM events) GROUP BY user_id")
def shared_error_kind(t: Tables) -> DataFrame:
    return ops.shared_kind(t.events.select("user_id", F.when(F.col("event_type").isin("error", "signup"), F.col("event_type")).alias("kind")), ["user_id"], "kind")


@query("""SELECT user_id, CASE WHEN coalesce(n, 0) > 0 THEN lu ELSE coalesce(usd, 0) END AS usd, CASE WHEN coalesce(n, 0) > 0 THEN n ELSE coalesce(calls, 0) END AS calls, coalesce(n, 0) > 0 AS from_ledger FROM (SELECT user_id, count(*) * 0.25e0 AS usd, count(*) AS calls FROM events GROUP BY user_id)
FULL OUTER JOIN (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 0.5e0 ELSE 0.0e0 END) AS lu, sum(CASE WHEN event_type = 'error' THEN event_id % 2 ELSE 0 END)::BIGINT AS n FROM events GROUP BY user_id) USING (user_id)""")
def charged_spend(t: Tables) -> DataFrame:
    """What each user was charged: by the ledger, where it has attempts, else by the cache."""
    cached = t.events.groupBy("user_id").agg((F.count(F.lit(1)) * 0.25).alias("usd"), F.count(F.lit(1)).alias("calls"))
    failed = F.col("event_type") == "error"
    ledger = t.events.select("user_id", F.when(failed, 0.5).otherwise(0.0).alias("usd"), F.when(failed, F.col("event_id") % 2).otherwise(0).alias("attempts"))
    return ops.charged(cached, ledger, ["user_id"])


@query("SELECT count(*) FILTER (event_type = 'view') AS reachable, count(*) FILTER (event_type NOT IN ('view', 'error')) AS stranded, count(*) FILTER (event_type = 'error') AS unknown FROM events")
def cache_census(t: Tables) -> DataFrame:
    return ops.cache_census(t.events.select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("prompt")), "prompt", "view")


@query(f"""WITH f AS (SELECT p_partkey, unnest(list_filter([CASE WHEN land_span - land_length <= 0 THEN 'rows meet' END, CASE WHEN land_width >= pitch THEN 'lands touch' END, CASE WHEN land_span_cross <= land_length THEN 'cross rows meet' END], lambda x: x IS NOT NULL)) AS guard, land_length IS NOT NULL AND land_width IS NOT NULL AS printed FROM ({RECORDS_SQL}))
SELECT guard, count(p_partkey) AS fires, count(*) FILTER (printed) AS costs FROM (VALUES ('rows meet'), ('lands touch'), ('cross rows meet'), ('never')) AS g(guard) LEFT JOIN f USING (guard) GROUP BY guard""")
def guard_counts(t: Tables) -> DataFrame:
    """How often each guard of the printed land fires, and how often that throws away a whole printed land."""
    c = F.col
    fired = F.array_compact(F.array(F.when(c("land_span") - c("land_length") <= 0, "rows meet"), F.when(c("land_width") >= c("pitch"), "lands touch"), F.when(c("land_span_cross") <= c("land_length"), "cross rows meet")))
    parts = records(t).select("p_partkey", fired.alias("fired"), (c("land_length").isNotNull() & c("land_width").isNotNull()).alias("printed"))
    guards = t.spark.createDataFrame([("rows meet",), ("lands touch",), ("cross rows meet",), ("never",)], "guard string")
    return ops.guard_counts(parts, guards, "p_partkey", "fired", "printed")


@query(f"SELECT p_partkey, unnest(['pin_count', 'lead.form', 'body.length']) AS path, unnest([pin_count::VARCHAR, lead_form, coalesce(cast(body_length * 100 AS INTEGER)::VARCHAR, '(null)')]) AS value FROM ({RECORDS_SQL})")
def fingerprint_rows(t: Tables) -> DataFrame:
    """Records as rows of path and text, to be compared between runs (see run_diff)."""
    c = F.col
    return ops.flattened(records(t), "p_partkey", {"pin_count": c("pin_count"), "lead.form": c("lead_form"), "body.length": F.round(c("body_length") * 100).cast("int")})


@query("""SELECT doc_id, sha256('v3' || chr(10) || 'small-' || lang || chr(10) || coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '1:image/png:4' || chr(10) || 'QUJD' ELSE '' END) AS request_sha256 FROM documents""")
def request_fingerprints(t: Tables) -> DataFrame:
    image = F.array(F.struct(F.lit(1).alias("page"), F.lit("image/png").alias("kind"), F.lit("QUJD").alias("base64")))
    images = F.when(F.col("doc_id") % 2 == 0, image).otherwise(F.array().cast("array<struct<page:int,kind:string,base64:string>>"))
    return t.documents.select("doc_id", ops.request_key(3, F.concat(F.lit("small-"), "lang"), F.coalesce("text", F.lit("")), images).alias("request_sha256"))


@query("SELECT user_id, count(DISTINCT event_type) > 1 AS stitched FROM events GROUP BY user_id")
def stitched_records(t: Tables) -> DataFrame:
    return ops.stitched(t.events, "user_id", "event_type")


@query(f"""SELECT CASE WHEN wrong THEN 'not a datasheet' WHEN n = 0 AND tables_ > 0 THEN 'a pinout for each package' WHEN n = 0 AND cnt IS NULL THEN 'no pins, no count' WHEN n = 0 THEN 'count but no pins' WHEN cnt IS NULL THEN 'pins but no count' ELSE 'read' END AS reason, count(*) AS parts
FROM (SELECT len(pins) AS n, p_partkey % 3 AS tables_, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE pin_count END AS cnt, p_partkey % 37 = 0 AS wrong FROM ({RECORDS_SQL})) GROUP BY 1""")
def holdout_reasons(t: Tables) -> DataFrame:
    """Why parts of a hold-out were read or not."""
    c = F.col
    reason = ops.reading_reason(F.size("pins"), F.when(c("p_partkey") % 4 != 0, c("pin_count")), c("p_partkey") % 3, c("p_partkey") % 37 == 0)
    return records(t).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("parts"))


_ASKED = ["pitch", "body_width", "land_length", "contact_min", "span_min"]
_ANSWERS = {n: f"case when p_partkey % {k} = 0 then null else 1.0e0 end" for n, k in zip(_ASKED, (21, 26, 27, 24, 50), strict=True)}
_BLANKS = "list_filter([" + ", ".join(f"CASE WHEN {n} IS NULL THEN CASE WHEN ({a}) IS NULL THEN 0 ELSE 1 END END" for n, a in _ANSWERS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""SELECT status, asked, count(*) AS parts FROM (SELECT CASE WHEN stuck > 0 AND stuck <= 4 THEN 'stuck' WHEN len(b) > 4 THEN 'asks' ELSE 'ships' END AS status, CASE WHEN stuck > 0 AND stuck <= 4 THEN stuck - 1 ELSE least(4, len(b)) END::INTEGER AS asked FROM (SELECT b, coalesce(list_position(b, 0), 0) AS stuck FROM (SELECT {_BLANKS} AS b FROM ({RECORDS_SQL})))) GROUP BY ALL""")
def answer_rounds(t: Tables) -> DataFrame:
    """Parts by what four rounds of questions lead to, with some answers unknown."""
    rows = records(t).selectExpr("*", *(f"{a} as answer_{n}" for n, a in _ANSWERS.items()))
    return ops.answered(rows, _ASKED).groupBy("status", "asked").agg(F.count(F.lit(1)).alias("parts"))


@query(f"""SELECT k, count(*) FILTER (f <= 2 AND value IS NOT NULL) AS identity, count(*) FILTER (f > 2 AND value IS NOT NULL) AS geometry, count(*) FILTER (value IS NOT NULL AND citation IS NOT NULL) AS cited, count(*) FILTER (f IN (1, 4) AND value IS NOT NULL) = 2 AS ships FROM ({MERGED_SQL}) GROUP BY k""")
def score_rows(t: Tables) -> DataFrame:
    """Each record's score: fields of each group filled, fields cited, and whether it ships."""
    c = F.col
    wide = merged(t).groupBy("k").agg(*(F.max(F.when(c("f") == n, F.struct("value", "citation"))).alias(f"f{n}") for n in range(1, 6)))
    return ops.scored(wide, "k", {"identity": ["f1", "f2"], "geometry": ["f3", "f4", "f5"]}, ["f1", "f4"])


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'span' WHEN 1 THEN 'pitch,span' WHEN 2 THEN 'pitch' ELSE 'pitch,span,height' END AS declined FROM part")
def declined_fields(t: Tables) -> DataFrame:
    """Fields that two passes looked for in vain, without those that one of them answered."""
    size = F.col("p_size") % 4
    answered = F.when(size == 0, F.array(F.lit("pitch"), F.lit("height"))).when(size == 2, F.array(F.lit("span"), F.lit("height"))).when(size == 1, F.array(F.lit("height"))).otherwise(F.array().cast("array<string>"))
    found = ops.declined(F.array(F.lit("pitch"), F.lit("span")), F.array(F.lit("span"), F.lit("height")), answered)
    return t.part.select("p_partkey", F.array_join(found, ",").alias("declined"))


@query("""SELECT s_suppkey, unnest(list_filter([CASE WHEN s_suppkey % 4 = 0 THEN 'no key' END, CASE WHEN s_acctbal < 0 THEN 'budget too low' END, CASE WHEN s_suppkey % 6 = 0 THEN 'public address' END], lambda x: x IS NOT NULL)) AS rule,
unnest(list_filter([CASE WHEN s_suppkey % 4 = 0 THEN 'error' END, CASE WHEN s_acctbal < 0 THEN 'warning' END, CASE WHEN s_suppkey % 6 = 0 THEN 'error' END], lambda x: x IS NOT NULL)) AS level FROM supplier""")
def preflight(t: Tables) -> DataFrame:
    """What is wrong with each configuration, by rule."""
    c = F.col
    return ops.findings(t.supplier, "s_suppkey", {"no key": ("error", c("s_suppkey") % 4 == 0), "budget too low": ("warning", c("s_acctbal") < 0), "public address": ("error", c("s_suppkey") % 6 == 0)})


@query("""SELECT user_id, event_type AS field, arg_min(value, (g, event_id)) AS value, arg_min(event_id, (g, event_id)) AS page FROM (SELECT *, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 1000000 END AS g FROM events WHERE value IS NOT NULL AND event_id % 3 <> 0) GROUP BY user_id, event_type""")
def focused_answers(t: Tables) -> DataFrame:
    """Answers to questions asked in groups, the first of each field."""
    groups = t.spark.createDataFrame([("view", 1), ("click", 1), ("error", 2)], "field string, group_no int")
    rows = t.events.select("user_id", F.col("event_type").alias("field"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.col("event_id").alias("page"))
    return ops.first_answers(rows, ["user_id"], groups, "field", "page")
