"""Keyed state machines over event tables: each key's rows in time order, a small state carried from row to row.

Rows are spread by key and sorted within the partitions; a partition is streamed through, so a key's history is never
held as a whole, whatever its length.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(df: DataFrame, keys: list[str], order: list[str], step: Callable[[Any, tuple], tuple[Any, tuple]], columns: list[str], out: str, needed: int = 1) -> DataFrame:
    """keys, order columns and what step gives for each row: step(state, values of columns) -> (state, outputs); state begins as None.

    out: schema of the outputs, as "name type, ...". A null is a key of its own; a row with a null among the first
    `needed` columns (the time, as a rule) changes no state, and its outputs are null.
    """
    head = list(dict.fromkeys([*keys, *order]))
    need = list(dict.fromkeys([*head, *columns]))
    outputs = StructType.fromDDL(out)
    schema = StructType([df.schema[c] for c in head] + outputs.fields)
    arrow, nothing = to_arrow_schema(schema), (None,) * len(outputs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            found, values = [], [batch.column(c).to_pylist() for c in (*keys, *columns)]
            for row in zip(*values, strict=True):
                k, given = tuple("nan" if x != x else x for x in row[: len(keys)]), row[len(keys) :]
                if k != key:
                    key, state = k, None
                if None in given[:needed]:
                    found.append(nothing)
                    continue
                state, made = step(state, given)
                found.append(made)
            made = zip(*found, strict=True) if found else [()] * len(outputs)
            kept = [batch.column(c) for c in head]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, arrow.field(len(head) + i).type) for i, x in enumerate(made))], schema=pa.schema([pa.field(f.name, k.type) for f, k in zip(arrow, kept, strict=False)] + [arrow.field(len(head) + i) for i in range(len(outputs))]))

    return df.select(need).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)


def fixed_window(events: DataFrame, key: str, at: str, order: list[str], limit: int, window: int) -> DataFrame:
    """allowed, remaining, retry_after (seconds) for each event. at: seconds, as a long.

    A window opens at a key's first hit and lasts `window` seconds; it reopens at the first hit at or after its end;
    hits over the limit are denied and not counted.
    """

    def step(state, values):
        (now,) = values
        if state is None or state[1] <= now:
            return (1, now + window), (True, limit - 1, 0)
        count, until = state
        if count >= limit:
            return state, (False, 0, max(1, until - now))
        return (count + 1, until), (True, limit - count - 1, 0)

    return fold(events, [key], order, step, [at], "allowed boolean, remaining int, retry_after long")


def ttl_cache(requests: DataFrame, key: str, at: str, order: list[str], found: str, hit_ttl: int = 3600, miss_ttl: int = 300) -> DataFrame:
    """outcome of each request: hit, known_miss (a live tombstone) or fetch; what a fetch finds (column `found`) is kept for its time to live."""

    def step(state, values):
        now, exists = values
        if state is not None and state[0] > now:
            return state, ("hit" if state[1] else "known_miss",)
        return (now + (hit_ttl if exists else miss_ttl), exists), ("fetch",)

    return fold(requests, [key], order, step, [at, found], "outcome string")


def lru_cache(requests: DataFrame, cache: str, key: str, at: str, order: list[str], capacity: int = 500, ttl: int | None = None) -> DataFrame:
    """outcome (hit or fetch) and `evicted` (how many entries went) of each request to a cache of `capacity` entries.

    One state for each value of `cache`: what was used last stays longest, and a read counts as a use. With a time to
    live an entry older than it is fetched anew.
    """

    def step(state, values):
        now, wanted = values
        state = OrderedDict() if state is None else state
        live = wanted in state and (ttl is None or state[wanted] + ttl > now)
        if not live:
            state[wanted] = now
        state.move_to_end(wanted)
        gone = max(0, len(state) - capacity)
        for _ in range(gone):
            state.popitem(last=False)
        return state, ("hit" if live else "fetch", gone)

    return fold(requests, [cache], order, step, [at, key], "outcome string, evicted long", 2)


def circuit_breaker(calls: DataFrame, key: str, at: str, order: list[str], blocked: str, threshold: int = 3, cooldown: int = 600) -> DataFrame:
    """state of each call: skipped (the breaker is open), blocked, opened (the block that opens it) or ok. Success clears the count."""

    def step(state, values):
        now, bad = values
        count, until = state or (0, None)
        if until is not None and until > now:
            return (count, until), ("skipped",)
        if not bad:
            return (0, None), ("ok",)
        if count + 1 >= threshold:
            return (0, now + cooldown), ("opened",)
        return (count + 1, until), ("blocked",)

    return fold(calls, [key], order, step, [at, blocked], "state string")


def pacer(requests: DataFrame, key: str, at: str, order: list[str], limit: int, window: int = 60_000, margin: int = 250) -> DataFrame:
    """sent and waited of each request: when it goes out so that no `window` holds more than `limit` of a key's. All times in milliseconds.

    A request goes out when the one before it has, or when it is made, whichever is later. If `limit` went out within
    the window before that, it waits until the oldest of them is out of the window, and `margin` more. So a wait moves
    all later requests; the state is the times of the last `limit` sent.
    """

    def step(state, values):
        (made,) = values
        sent = state or deque(maxlen=limit)
        now = max(made, sent[-1]) if sent else made
        if len(sent) == limit and now - sent[0] < window:
            now = sent[0] + window + margin
        sent.append(now)
        return sent, (now, now - made)

    return fold(requests, [key], order, step, [at], "sent long, waited long")


def single_flight(requests: DataFrame, keys: list[str], at: str, order: list[str], takes: str, request: str) -> DataFrame:
    """leader and until of each request: who fetches for it, and when that fetch is done.

    A request that comes while one for its keys is in flight shares its answer; else it leads, and is in flight for
    what it takes. What a request would take counts only if it leads; a failed flight ends like any other, so no key
    stays wedged.
    """
    kind = requests.schema[request].dataType.simpleString()

    def step(state, values):
        now, lasts, me = values
        if state is None or state[1] <= now:
            state = (me, now + (lasts or 0))
        return state, state

    return fold(requests, keys, order, step, [at, takes, request], f"leader {kind}, until long")


def resolution_store(requests: DataFrame, cache: str, key: str, at: str, order: list[str], found: str, capacity: int = 500, hit_ttl: int = 3600, miss_ttl: int = 300) -> DataFrame:
    """outcome (hit, known_miss or fetch), evicted and held of each request to a store of answers: times to live, tombstones and recency in one.

    A live entry answers, be it a find or a known miss, and a read makes it the most recent; one past its time goes
    when it is asked for. A fetch stores what it finds (column `found`) for its time to live, and then the least
    recent entries go until `capacity` are left, live or not.
    """

    def step(state, values):
        now, wanted, exists = values
        state = OrderedDict() if state is None else state
        entry = state.pop(wanted, None)
        live = entry is not None and entry[0] > now
        state[wanted] = entry if live else (now + (hit_ttl if exists else miss_ttl), bool(exists))
        gone = max(0, len(state) - capacity)
        for _ in range(gone):
            state.popitem(last=False)
        outcome = ("hit" if entry[1] else "known_miss") if live else "fetch"
        return state, (outcome, gone, len(state))

    return fold(requests, [cache], order, step, [at, key, found], "outcome string, evicted long, held long", 2)


def searched(requests: DataFrame, client: str, at: str, order: list[str], answers: dict[str, str], threshold: int = 3, cooldown: int = 600) -> DataFrame:
    """backend, blocked and route of each search: the first backend that answers, or whether none could.

    answers: backend -> the column with what it would say now: `ok` (also without results), `blocked`, `error`, or
    null where it isn't set up. Backends are asked in order. One that blocks `threshold` times in a row is left out for
    `cooldown` seconds and counts as blocking meanwhile; an answer clears its count, a failed transport changes nothing.
    All requests of a client share the breakers. blocked: nobody answered, and somebody refused or nobody could be asked,
    so that nothing was learnt. route: what happened at each backend, in order.
    """

    def step(state, values):
        now, given = values[0], values[1:]
        state = dict(state or {})
        route, refused, asked = [], False, False
        for name, said in zip(answers, given, strict=True):
            count, until = state.get(name, (0, None))
            if said is None:
                route.append("-")
            elif until is not None and until > now:
                route.append("open")
                refused = True
            else:
                asked = True
                route.append(said)
                if said == "ok":
                    state[name] = (0, None)
                    return state, (name, False, ",".join(route))
                if said == "blocked":
                    refused = True
                    state[name] = (0, now + cooldown) if count + 1 >= threshold else (count + 1, until)
        return state, (None, refused or not asked, ",".join(route))

    return fold(requests, [client], order, step, [at, *answers.values()], "backend string, blocked boolean, route string")


def latest_nonnull(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last value that isn't null of each key, by order: an aggregate with partial results, no sort of a key's rows."""
    last = F.max_by(F.col(value), F.struct(*order))
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(last.alias(value))


def client_key(forwarded: Column, real: Column) -> Column:
    """Whose allowance a request uses: the first address a proxy forwarded, else the one it names, else one shared by all unknown."""
    first, own = F.trim(F.substring_index(forwarded, ",", 1)), F.trim(real)
    return F.coalesce(F.when(first != "", first), F.when(own != "", own), F.lit("unknown"))


def cache_key(part: Column, maker: Column) -> Column:
    from ..functions.text import normalised_part

    return F.concat_ws("|", normalised_part(part), F.lower(F.trim(F.coalesce(maker, F.lit("")))))


def retry_after_ms(message: Column, fallback: int = 45_000, most: int = 180_000) -> Column:
    """How long a service asks to wait ("retry in 5.2s"), with two seconds to spare, else the fallback; at most `most`."""
    stated = F.regexp_extract(message, r"(?i)retry in ([0-9]+(?:\.[0-9]+)?)\s*s", 1).try_cast("double")
    return F.least(F.coalesce(F.ceil(F.round(stated * 1000, 3)) + 2000, F.lit(fallback)), F.lit(most)).cast("long")


def backoff_ms(attempt: Column, kind: Column, attempts: int = 3, base: int = 2000) -> Column:
    """The wait before the next attempt, doubling; null where there is none: enough were made, or a failure that comes again."""
    return F.when((attempt < attempts) & (kind == "transient"), (base * F.pow(F.lit(2.0), attempt - 1)).cast("long"))


def model_budget_ms(route: Column, elapsed: Column, ceiling: Column, margin: int = 3000, least: int = 5000) -> tuple[Column, Column]:
    """What is left of a route's time for a model, and whether that is worth a call."""
    left = route - margin - elapsed
    left = F.when(ceiling > 0, F.least(ceiling, left)).otherwise(left)
    return left, left >= least


def evictions(first_seen: DataFrame, key: str, at: str, expires: str, now: int, most: int = 10_000, buckets: int = 1024) -> DataFrame:
    """key, why: which keys a full store lets go before it takes another: none below `most`; else the expired, and the oldest until one place is free.

    at: a number. Who is oldest is found by counting: keys are dealt to `buckets` of equal width of `at`, whole buckets
    go, and only the one in which the limit falls is put in order.
    """
    rows = first_seen.select(key, at, (F.col(expires) <= now).alias("_dead"))
    held = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_dead")).alias("live"), F.min(at).alias("low"), F.max(at).alias("high")).first()
    dead, none = rows.where("_dead").select(key, F.lit("expired").alias("why")), rows.where("false").select(key, F.lit("").alias("why"))
    if held.n < most:
        return none
    over = held.live - (most - 1)
    if over <= 0 or not held.live:
        return dead
    place = F.least(F.floor((F.col(at) - held.low) * buckets / ((held.high - held.low) or 1)), F.lit(buckets - 1)).cast("int")
    live = rows.where("not _dead").withColumn("_place", place)
    left, last = over, None
    for place, n in sorted(live.groupBy("_place").agg(F.count(F.lit(1)).alias("n")).collect()):  # `buckets` rows at most
        if n >= left:
            last = place
            break
        left -= n
    nth = F.row_number().over(Window.partitionBy("_place").orderBy(at, key))
    cut = live.where(F.col("_place") == last).withColumn("_n", nth).where(F.col("_n") <= left)
    oldest = live.where(F.col("_place") < last).select(key).union(cut.select(key))
    return dead.union(oldest.select(key, F.lit("oldest").alias("why")))
