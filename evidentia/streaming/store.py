"""The store of answers over an unbounded stream of requests: keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


class Store(StatefulProcessor):
    """The decisions of operators.state.resolution_store for the requests of one cache, in order of event time.

    State is a map of what is held, never more than `capacity` entries, and a counter that says what was used last. A
    timer stands at the end of the longest life: a cache that nobody asks until then leaves nothing behind.
    """

    def __init__(self, key_type: StructField, columns: tuple[str, str, str, str], capacity: int, hit_ttl: int, miss_ttl: int):
        self.key_schema, self.columns = StructType([StructField("key", key_type.dataType)]), columns
        self.capacity, self.hit_ttl, self.miss_ttl = capacity, hit_ttl, miss_ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", self.key_schema, StructType([StructField("until", LongType()), StructField("found", BooleanType()), StructField("used", LongType())]))
        self.clock = handle.getValueState("clock", StructType([StructField("uses", LongType()), StructField("last", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        uses, last = self.clock.get() if self.clock.exists() else (0, 0)
        held = sum(1 for _ in self.entries.keys())
        request, wanted_, at_, found_ = self.columns
        for row in sorted(rows, key=lambda r: (r[at_], r[request])):
            now, wanted = row[at_], (row[wanted_],)
            entry = self.entries.getValue(wanted) if self.entries.containsKey(wanted) else None
            live = entry is not None and entry[0] > now
            until, found = entry[:2] if live else (now + (self.hit_ttl if row[found_] else self.miss_ttl), bool(row[found_]))
            uses, held, last = uses + 1, held + (entry is None), max(last, until)
            self.entries.updateValue(wanted, (until, found, uses))
            if held > self.capacity:
                least = min(self.entries.iterator(), key=lambda e: e[1][2])[0]
                self.entries.removeKey(least)
                held -= 1
            yield Row(cache=key[0], request=row[request], outcome=("hit" if found else "known_miss") if live else "fetch")
        self.clock.update((uses, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.entries.clear()
        self.clock.clear()
        return iter(())

    def close(self) -> None:
        pass


def resolution_store(requests: DataFrame, cache: str, key: str, at: str, request: str, found: str, capacity: int = 500, hit_ttl: int = 3600, miss_ttl: int = 300) -> DataFrame:
    """cache, request, outcome of a stream. at: seconds, a long, beside a watermark on the same time; needs the RocksDB state store.

    The same outcomes as the batch twin's for requests that come in order from batch to batch; within one they are
    put in order. A null time or key has no outcome.
    """
    kind = lambda c: requests.schema[c].dataType.simpleString()
    rows = requests.where(F.col(at).isNotNull() & F.col(key).isNotNull())
    processor = Store(requests.schema[key], (request, key, at, found), capacity, hit_ttl, miss_ttl)
    out = f"cache {kind(cache)}, request {kind(request)}, outcome string"
    return rows.groupBy(cache).transformWithState(processor, out, "Append", "EventTime")
