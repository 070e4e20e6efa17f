"""State machines over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import state as ops
from .registry import Registry, Tables

REGISTRY = Registry()
query = REGISTRY.query

_EV = "SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS s FROM events"


def events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "value", F.unix_seconds("ts").alias("s"))


def _fold_sql(row: str, start: str, step: str, out: str, key: str = "user_id") -> str:
    """DuckDB: a fold over each key's rows in time order, every prefix's last state being that row's."""
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s, event_id) AS k FROM ({row})),
f AS (SELECT {key}, k, event_id, s, {start} FROM e WHERE k = 1 UNION ALL SELECT e.{key}, e.k, e.event_id, e.s, {step} FROM f JOIN e ON e.{key} = f.{key} AND e.k = f.k + 1) SELECT event_id, {key}, {out} FROM f"""


@query(_fold_sql(_EV, "1 AS n, s + 3600 AS until, true AS allowed", "CASE WHEN f.until <= e.s THEN 1 WHEN f.n >= 2 THEN f.n ELSE f.n + 1 END, CASE WHEN f.until <= e.s THEN e.s + 3600 ELSE f.until END, f.until <= e.s OR f.n < 2",
                 "allowed, CASE WHEN allowed THEN 2 - n ELSE 0 END AS remaining, CASE WHEN allowed THEN 0 ELSE greatest(1, until - s) END AS retry_after"))
def rate_limit_fixed(t: Tables) -> DataFrame:
    return ops.fixed_window(events(t), "user_id", "s", ["s", "event_id"], 2, 3600).select("event_id", "user_id", "allowed", "remaining", "retry_after")


@query(_fold_sql(_EV, "s + CASE WHEN value >= 20 THEN 36000 ELSE 3000 END AS until, value >= 20 AS found, 'fetch' AS outcome",
                 "CASE WHEN f.until > e.s THEN f.until ELSE e.s + CASE WHEN e.value >= 20 THEN 36000 ELSE 3000 END END, CASE WHEN f.until > e.s THEN f.found ELSE e.value >= 20 END, CASE WHEN f.until <= e.s THEN 'fetch' WHEN f.found THEN 'hit' ELSE 'known_miss' END", "outcome"))
def ttl_cache(t: Tables) -> DataFrame:
    rows = events(t).withColumn("found", F.coalesce(F.col("value") >= 20, F.lit(False)))
    return ops.ttl_cache(rows, "user_id", "s", ["s", "event_id"], "found", 36000, 3000).select("event_id", "user_id", "outcome")


@query(_fold_sql(_EV, "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS n, NULL::BIGINT AS until, CASE WHEN event_type = 'error' THEN 'blocked' ELSE 'ok' END AS state",
                 """CASE WHEN f.until > e.s THEN f.n WHEN e.event_type <> 'error' OR f.n + 1 >= 2 THEN 0 ELSE f.n + 1 END, CASE WHEN f.until > e.s THEN f.until WHEN e.event_type <> 'error' THEN NULL WHEN f.n + 1 >= 2 THEN e.s + 86400 ELSE f.until END,
                 CASE WHEN f.until > e.s THEN 'skipped' WHEN e.event_type <> 'error' THEN 'ok' WHEN f.n + 1 >= 2 THEN 'opened' ELSE 'blocked' END""", "state"))  # fmt: skip
def circuit_breaker(t: Tables) -> DataFrame:
    rows = events(t).withColumn("bad", F.col("event_type") == "error")
    return ops.circuit_breaker(rows, "user_id", "s", ["s", "event_id"], "bad", 2, 86400).select("event_id", "user_id", "state")


@query(_fold_sql(_EV, "[s * 1000] AS sent", "CASE WHEN len(f.sent) = 3 AND greatest(e.s * 1000, f.sent[-1]) - f.sent[1] < 50000000 THEN list_append(f.sent[2:], f.sent[1] + 50000250) ELSE list_append(CASE WHEN len(f.sent) = 3 THEN f.sent[2:] ELSE f.sent END, greatest(e.s * 1000, f.sent[-1])) END",
                 "sent[-1] AS sent, sent[-1] - s * 1000 AS waited"))
def sliding_pacer(t: Tables) -> DataFrame:
    """A user's requests, three in any 50,000 seconds at most: each wait moves what comes later."""
    rows = events(t).withColumn("ms", F.col("s") * 1000)
    return ops.pacer(rows, "user_id", "ms", ["ms", "event_id"], 3, 50_000_000).select("event_id", "user_id", "sent", "waited")


@query(_fold_sql(_EV, "event_id AS leader, s + (coalesce(value, 0) * 200)::BIGINT AS until", "CASE WHEN f.until <= e.s THEN e.event_id ELSE f.leader END, CASE WHEN f.until <= e.s THEN e.s + (coalesce(e.value, 0) * 200)::BIGINT ELSE f.until END",
                 "leader, until", "event_type"))
def single_flight(t: Tables) -> DataFrame:
    """Who fetches for whom, of requests by type of event, each in flight for two hundred seconds a unit of its value."""
    rows = events(t).withColumn("takes", F.round(F.coalesce("value", F.lit(0.0)) * 200).cast("long"))
    return ops.single_flight(rows, ["event_type"], "s", ["s", "event_id"], "takes", "event_id").select("event_id", "event_type", "leader", "until")


_HELD = "list_filter(f.held, lambda x: x.u <> e.user_id)"
_ENTRY = "list_filter(f.held, lambda x: x.u = e.user_id)[1]"
_LIVE = f"coalesce({_ENTRY}.until > e.s, false)"
_NEXT = f"list_append({_HELD}, CASE WHEN {_LIVE} THEN {_ENTRY} ELSE {{'u': e.user_id, 'until': e.s + CASE WHEN e.value >= 20 THEN 900000 ELSE 90000 END, 'found': coalesce(e.value >= 20, false)}} END)"


@query(_fold_sql(_EV, "[{'u': user_id, 'until': s + CASE WHEN value >= 20 THEN 900000 ELSE 90000 END, 'found': coalesce(value >= 20, false)}] AS held, 'fetch' AS outcome, 0::BIGINT AS evicted",
                 f"({_NEXT})[-40:], CASE WHEN NOT {_LIVE} THEN 'fetch' WHEN {_ENTRY}.found THEN 'hit' ELSE 'known_miss' END, greatest(0, len({_HELD}) + 1 - 40)::BIGINT", "outcome, evicted, len(held) AS held", "event_type"))
def resolution_store(t: Tables) -> DataFrame:
    """Lookups of users in a store of forty answers for each type of event: finds live for ten days, known misses for one."""
    rows = events(t).withColumn("found", F.coalesce(F.col("value") >= 20, F.lit(False))).withColumnRenamed("user_id", "user")
    found = ops.resolution_store(rows, "event_type", "user", "s", ["s", "event_id"], "found", 40, 900_000, 90_000)
    return found.select("event_id", "event_type", "outcome", "evicted", "held")


#: What three backends would say to each search: the second isn't set up for every client.
_SAID = {
    "first": "case when event_type = 'error' then 'blocked' when event_id % 5 = 0 then 'error' when event_id % 4 > 0 then 'blocked' else 'ok' end",
    "second": "case when user_id % 3 = 0 then null when event_id % 3 = 0 then 'ok' else 'blocked' end",
    "third": "case when event_id % 7 = 0 then 'ok' when event_id % 2 = 0 then 'error' else 'blocked' end",
}


def _search_sql() -> str:
    """The route as nested cases: for each backend, whether it is reached, open and asked, and its breaker behind it."""
    start, steps, reached, refused, asked = [], [], "true", [], []
    route: list[str] = []
    for k, name in enumerate(_SAID):
        n, until = f"f.n{k}", f"coalesce(f.u{k}, 0)"
        open_ = f"({until} > e.s)"
        said = f"e.{name}"
        here = f"({reached} AND {said} IS NOT NULL AND NOT {open_})"
        steps += [
            f"CASE WHEN {here} AND {said} = 'ok' THEN 0 WHEN {here} AND {said} = 'blocked' THEN CASE WHEN {n} + 1 >= 3 THEN 0 ELSE {n} + 1 END ELSE {n} END",
            f"CASE WHEN {here} AND {said} = 'ok' THEN NULL WHEN {here} AND {said} = 'blocked' AND {n} + 1 >= 3 THEN e.s + 86400 ELSE f.u{k} END",
        ]
        start += [f"0 AS n{k}", f"NULL::BIGINT AS u{k}"]
        route.append(f"CASE WHEN NOT {reached} THEN NULL WHEN {said} IS NULL THEN '-' WHEN {open_} THEN 'open' ELSE {said} END")
        refused.append(f"coalesce({reached} AND {said} IS NOT NULL AND ({open_} OR {said} = 'blocked'), false)")
        asked.append(f"coalesce({here}, false)")
        reached = f"({reached} AND NOT coalesce({here} AND {said} = 'ok', false))"
    backend = "CASE " + " ".join(f"WHEN {a} AND e.{name} = 'ok' THEN '{name}'" for a, name in zip(asked, _SAID, strict=True)) + " END"
    blocked = f"({backend}) IS NULL AND (({' OR '.join(refused)}) OR NOT ({' OR '.join(asked)}))"
    said = ", ".join(f"{x} AS {n}" for n, x in _SAID.items())
    # a client begins with closed breakers: a row before its first
    rows = f"SELECT event_id, user_id, s, {said} FROM ({_EV})"
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM ({rows})),
f AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, {", ".join(start)}, NULL::VARCHAR AS backend, false AS blocked, '' AS route FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, e.event_id, {", ".join(steps)}, {backend}, {blocked}, concat_ws(',', {", ".join(route)}) FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, user_id, backend, blocked, route FROM f WHERE k > 0"""


@query(_search_sql())
def search_client(t: Tables) -> DataFrame:
    """Searches of each user over three backends whose breakers they share, a day each."""
    rows = events(t).select("*", *(F.expr(x).alias(n) for n, x in _SAID.items()))
    return ops.searched(rows, "user_id", "s", ["s", "event_id"], {n: n for n in _SAID}, 3, 86_400).select("event_id", "user_id", "backend", "blocked", "route")


@query(f"SELECT user_id, event_type, arg_max(value, (s, event_id)) AS value FROM ({_EV.replace('value,', 'CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value,')}) WHERE value IS NOT NULL GROUP BY ALL")
def latest_nonnull(t: Tables) -> DataFrame:
    rows = events(t).withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return ops.latest_nonnull(rows, ["user_id", "event_type"], ["s", "event_id"], "value")


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY s, event_id) AS i FROM ({_EV})), p AS (SELECT *, lag(i) OVER (PARTITION BY event_type, user_id ORDER BY i) AS before, row_number() OVER (PARTITION BY event_type, user_id ORDER BY i) AS nth FROM e),
d AS (SELECT a.event_id, count(DISTINCT b.user_id) AS between_ FROM p a JOIN p b ON a.event_type = b.event_type AND b.i > a.before AND b.i < a.i GROUP BY a.event_id),
h AS (SELECT p.event_id, p.event_type, p.user_id, p.i, before IS NOT NULL AND coalesce(between_, 0) < 60 AS hit FROM p LEFT JOIN d USING (event_id))
SELECT event_id, event_type, CASE WHEN hit THEN 'hit' ELSE 'fetch' END AS outcome, CASE WHEN NOT hit AND sum((NOT hit)::INTEGER) OVER (PARTITION BY event_type ORDER BY i) > 60 THEN 1 ELSE 0 END::BIGINT AS evicted FROM h""")
def lru_cache(t: Tables) -> DataFrame:
    """A cache of sixty users for each type of event: a request hits if fewer than sixty others came since its last."""
    rows = ops.lru_cache(events(t).withColumnRenamed("user_id", "user"), "event_type", "user", "s", ["s", "event_id"], 60)
    return rows.select("event_id", "event_type", "outcome", "evicted")


_CLIENT = "case event_id % 5 when 0 then '10.0.0.' || cast(user_id as string) || ', 10.9.9.9' when 1 then ' ' when 2 then null when 3 then ',x' else '1.2.3.4' end"


@query(f"""SELECT event_id, coalesce(nullif(trim(string_split(f, ',')[1]), ''), CASE WHEN event_id % 2 = 0 THEN '7.7.7.7' END, 'unknown') AS client, upper('tps' || user_id) || '|' || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'ti' END AS cache_key,
least(coalesce(CASE WHEN event_id % 2 = 0 THEN (event_id % 240) * 1000 + 500 + 2000 END, 45000), 180000)::BIGINT AS wait_ms, CASE WHEN event_id % 4 + 1 < 3 AND event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 2000 ELSE 4000 END END::BIGINT AS backoff_ms
FROM (SELECT *, {_CLIENT.replace('as string', 'as varchar')} AS f FROM events)""")
def request_keys(t: Tables) -> DataFrame:
    """Of each request: whose it is, what it asks the cache for, how long it waits after a refusal and after a failure."""
    e = t.events
    message = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Quota. Please Retry in "), (F.col("event_id") % 240).cast("string"), F.lit(".5s."))).otherwise("no idea")
    client = ops.client_key(F.expr(_CLIENT), F.when(F.col("event_id") % 2 == 0, " 7.7.7.7 "))
    key = ops.cache_key(F.concat(F.lit(" tps"), F.col("user_id").cast("string")), F.when(F.col("event_id") % 3 != 0, " TI "))
    kind = F.when(F.col("event_type") == "error", "transient").otherwise("permanent")
    return e.select("event_id", client.alias("client"), key.alias("cache_key"), ops.retry_after_ms(message).alias("wait_ms"), ops.backoff_ms(F.col("event_id") % 4 + 1, kind).alias("backoff_ms"))


@query("SELECT event_id, left_ms, left_ms >= 5000 AS worth FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(8000, 27000 - event_id % 40000) ELSE 27000 - event_id % 40000 END AS left_ms FROM events)")
def model_budgets(t: Tables) -> DataFrame:
    left, worth = ops.model_budget_ms(F.lit(30_000).cast("long"), F.col("event_id") % 40_000, F.when(F.col("event_id") % 3 == 0, F.lit(8000).cast("long")))
    return t.events.select("event_id", left.alias("left_ms"), worth.alias("worth"))


@query("""WITH k AS (SELECT user_id, min(event_id) AS at_, max(event_id) AS last_ FROM events GROUP BY user_id), s AS (SELECT *, last_ % 7 = 0 AS dead, count(*) OVER () AS held FROM k), l AS (SELECT user_id, row_number() OVER (ORDER BY at_, user_id) AS n, count(*) OVER () AS c FROM s WHERE NOT dead AND held >= 8)
SELECT user_id, 'expired' AS why FROM s WHERE dead AND held >= 8 UNION ALL SELECT user_id, 'oldest' FROM l WHERE n <= greatest(0, c - 7)""")
def store_evictions(t: Tables) -> DataFrame:
    """Which users a full store of eight keys lets go before it takes another."""
    keys = t.events.groupBy("user_id").agg(F.min("event_id").alias("at"), F.when(F.max("event_id") % 7 == 0, 0).otherwise(2).alias("until"))
    return ops.evictions(keys, "user_id", "at", "until", 1, 8)
