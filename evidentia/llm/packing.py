"""Mixture-controlled packing (operator 1).

Each source is a queue of tokens. Deficit round-robin serves the queues window by window: in every window a queue
earns its share of the window's tokens, serves whole tokens up to what it is owed, and carries the fraction left
over, its deficit, into the next window. Documents may be cut anywhere, so what a queue has served after any number
of windows has a closed form: with running weights A_0 <= A_1 <= ... <= A, queue k has served
floor(w L A_k / A) - floor(w L A_(k-1) / A) tokens after w windows of L. What a queue has served
strays from its targets by less than one token after any number of windows, so by less than two within a window, and
every window is full. A document that knows its place in its queue therefore finds its
windows by itself: deficits pass between partitions without any exchange of rows.

A target mixture lasts until a queue cannot fill its share any more. There the schedule gets a single window with
explicit quotas, which empties that queue, and goes on with the rest; so there are at most two phases per queue. With
no targets given, shares are the sources' shares of all tokens, and all queues empty together; with a temperature,
they are those shares to that power, so that small sources come earlier and more evenly (the query takes 0.7). The last,
partial window is cut into sequences whose lengths are powers of two, so nothing is padded.

Steps: tokenize once and write the ids with each row's place in its partition and queue; add up the partitions
(window over partitions by queue, as many rows as partitions times queues); join those small offsets to the rows and cut.
Sources too small for a queue of their own share one, in which their documents are dealt by place in the source over the
source's total, so their proportions hold all along it, to within a document; only their tokens are shuffled.

Defined results: a null text is an empty text; every document ends with the end id, so an empty one is that single
id; a null source is a queue of its own; repeated rows are packed as separate documents, each with its own pieces; an
empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, small, spare, stage, table, texts_of
from .tokens import word_tokenizer

WINDOW = 4096
END_ID = 2
#: Queues of a mixture at most that isn't the sources' own; each may add two phases to the schedule.
MAX_TARGETS = 256
#: The power of the sources' shares that the query aims at.
TEMPERATURE = 0.7

#: First window, windows, tokens served before and weights by queue, tokens of each window.
Phase = tuple[int, int, tuple[int, ...], tuple[int, ...], int]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of up to 4,096 rows and 10 MB: the more at once, the fewer words are looked at and encoded again."""
    return small(joined(batches, 4), 4096, 10 << 20)


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """part, source, place (tokens of that source earlier in the part), doc_id, n, ids (binary, uint16 or uint32 little-endian)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare()
        part, places, tokenizer = TaskContext.get().partitionId(), {}, word_tokenizer(tokenizer_path)
        end = np.array([end_id], tokenizer.kind).tobytes()
        for rows in gathered(batches):
            ids = [x + end for x in tokenizer.encode_batch(rows.column("text"))]
            counts = [len(x) // tokenizer.kind.itemsize for x in ids]
            sources, place = rows.column("queue").to_pylist(), []
            for s, n in zip(sources, counts, strict=True):
                place.append(places.get(s, 0))
                places[s] = place[-1] + n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(ids), pa.int32()), rows.column("queue"), pa.array(place, pa.int64()), rows.column("doc_id"),
                    pa.array(counts, pa.int64()), pa.array(ids, pa.binary()),
                ],
                ["part", "queue", "place", "doc_id", "n", "ids"],
            )

    return texts_of(docs, F.col("source").cast("string").alias("queue")).mapInArrow(
        encode, "part int, queue string, place long, doc_id long, n long, ids binary"
    )


def quotas(rest: list[int], weights: list[int], room: int) -> list[int]:
    """One window's tokens by queue: shares of room by weight, no queue beyond its rest, what that frees dealt out again."""
    out = [0] * len(rest)
    while (free := room - sum(out)) > 0:
        live = [k for k in range(len(rest)) if out[k] < rest[k]]
        if not live:
            break
        total = sum(weights[k] for k in live)
        for k in live:
            out[k] += min(rest[k] - out[k], free * weights[k] // total)
        if room - sum(out) == free:  # less than one token each: round the table once
            for k in sorted(live, key=lambda k: -weights[k])[:free]:
                out[k] += 1
    return out


def schedule(totals: list[int], weights: list[int], length: int = WINDOW) -> list[Phase]:
    """The phases of deficit round-robin over queues of these totals. Every weight is at least one part in length of their sum."""
    rest, phases, window = list(totals), [], 0
    while sum(rest) >= length:
        now = [w if r else 0 for w, r in zip(weights, rest, strict=True)]
        whole = sum(now)
        n = min(r * whole // (length * w) for r, w in zip(rest, now, strict=True) if w)
        served = [t - r for t, r in zip(totals, rest, strict=True)]
        if n:
            phases.append((window, n, tuple(served), tuple(now), length))
            run, before = 0, 0
            for k, w in enumerate(now):
                run += w
                upto = n * length * run // whole
                rest[k] -= upto - before
                before = upto
        else:
            n, quota = 1, quotas(rest, weights, length)
            phases.append((window, 1, tuple(served), tuple(quota), length))
            rest = [r - q for r, q in zip(rest, quota, strict=True)]
        window += n
    if any(rest):
        phases.append((window, 1, tuple(t - r for t, r in zip(totals, rest, strict=True)), tuple(rest), sum(rest)))
    return phases


class Layout:
    """Where each stretch of a queue lies. Only the last phase can have a window that isn't full."""

    def __init__(self, phases: list[Phase], length: int):
        self.phases = [(window, n, served, [0, *accumulate(weights)], size) for window, n, served, weights, size in phases]
        window, n, _, _, size = self.phases[-1] if self.phases else (0, 0, (), [0], length)
        self.whole = window if size < length else window + n  # full windows
        self.tail = []  # where the last sequences begin, within the partial window
        at = 0
        for bit in reversed(range(size.bit_length())) if size < length else ():
            if size >> bit & 1:
                self.tail.append((at, 1 << bit))
                at += 1 << bit

    def pieces(self, queue: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start within the document, length, sequence, offset) of n tokens at start of the queue."""
        done = 0
        for p, (window, count, served, upto, size) in enumerate(self.phases):
            last = p + 1 == len(self.phases)
            if not last and self.phases[p + 1][2][queue] <= start + done:
                continue
            a, b, whole = upto[queue], upto[queue + 1], upto[-1]
            if a == b:
                continue
            begin, width = start + done - served[queue], b - a
            w = max(0, min(count - 1, begin * whole // (size * width) - 1))
            while done < n and w < count:
                left, right = w * size * a // whole, (w + 1) * size * a // whole  # what the queues before it have served
                mine, mine_after = w * size * b // whole - left, (w + 1) * size * b // whole - right
                pos = start + done - served[queue]
                if pos >= mine_after:
                    w += 1
                    continue
                take = min(n - done, mine_after - pos)
                offset = right - left + pos - mine
                if window + w < self.whole:
                    yield done, take, window + w, offset
                else:
                    for k, (at, long) in enumerate(self.tail):
                        lo, hi = max(offset, at), min(offset + take, at + long)
                        if lo < hi:
                            yield done + lo - offset, hi - lo, self.whole + k, lo - at
                done += take
            if done == n:
                return


def weighted(totals: DataFrame, whole: int, targets: dict[str | None, float] | None, temperature: float) -> DataFrame:
    """totals (queue, tokens) with each source's weight. Sources without a target share what is left of 1 by their tokens."""
    if targets is None:
        return totals.withColumn("weight", F.pow(F.col("tokens") / whole, F.lit(float(temperature))))
    if len(targets) > MAX_TARGETS:
        raise ValueError(f"at most {MAX_TARGETS} targets")
    if any(not x > 0 for x in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets must be positive and add up to 1 at most")
    aims = totals.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()] or [("", 1.0)], "aimed string, aim double")
    found = totals.join(F.broadcast(aims), F.col("queue").eqNullSafe(F.col("aimed")), "left")
    others = found.where("aim is null").agg(F.sum("tokens")).first()[0] or 1
    rest = max(1 - sum(targets.values()), 2.0**-32)
    return found.select("queue", "tokens", F.coalesce("aim", F.col("tokens") * (rest / others)).alias("weight"))


def queues_of(totals: DataFrame, length: int, own: bool) -> tuple[dict, list[int], list[int]]:
    """Queue number by source, and each queue's tokens and weight, of totals (queue, tokens, weight).

    Sources owed less than two tokens a window share a queue, the last one, in the proportions of their weights (see
    dealt); so do, in a mixture that isn't the sources' own, all but the MAX_TARGETS largest. So the driver names at most length / 2.
    """
    sums = totals.agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("weight")).first()
    if not sums.tokens:
        return {}, [], []
    named = totals.where(F.col("weight") * length >= 2 * sums.weight)
    if not own:
        named = named.orderBy(F.col("weight").desc(), F.col("queue")).limit(MAX_TARGETS)
    rows = sorted(named.collect(), key=lambda r: (r.queue is not None, r.queue or ""))
    queue, tokens = {r.queue: k for k, r in enumerate(rows)}, [r.tokens for r in rows]
    weights = list(tokens) if own else [round(r.weight / sums.weight * 2**40) for r in rows]
    if left := sums.tokens - sum(tokens):
        rest = left if own else max(0, 2**40 - sum(weights))
        least = -(-2 * (sum(weights) + rest) // (length - 2))  # the shared queue is owed two tokens a window at least
        tokens, weights = [*tokens, left], [*weights, max(rest, least)]
    return queue, tokens, weights


def dealt(rows: DataFrame, parts: DataFrame, whole: int, number: int) -> DataFrame:
    """The rows of sources that share a queue, dealt to it in the proportions of their weights: by place in the source over its weight.

    Documents stay whole in this order, and each source begins with a phase of its own, so sources of one document spread
    as well. Running sums are taken within stretches of the queue, whose number grows with its tokens.
    """
    source = Window.partitionBy("queue")
    earlier = source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", "queue", "weight", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"), F.sum("tokens").over(source).alias("all"))
    bases = stage(bases, "bases")
    longest = bases.agg(F.max(F.col("all") / F.col("weight"))).first()[0]
    phase = F.pmod(F.xxhash64(rows.queue), F.lit(1 << 20)) / (1 << 20)
    at = (F.col("place") + F.col("base") + phase * F.col("n")) / F.col("weight") / longest
    stretches = max(1, min(1 << 16, whole >> 18))
    found = rows.join(bases, (rows.part == bases.part) & rows.queue.eqNullSafe(bases.queue)).select(
        "doc_id", rows.queue.alias("source_queue"), rows.part, "place", "n", "ids", at.alias("at"), F.least(F.floor(at * stretches), F.lit(stretches - 1)).alias("stretch")
    )
    upto = Window.partitionBy(F.lit(0)).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows
    starts = found.groupBy("stretch").agg(F.sum("n").alias("tokens")).select("stretch", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).alias("start"))
    within = Window.partitionBy("stretch").orderBy("at", F.col("source_queue").asc_nulls_first(), "part", "place").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("run", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(stage(starts, "stretches")), "stretch")
    return found.select("doc_id", "source_queue", F.lit(number).cast("long").alias("number"), (F.col("start") + F.col("run")).alias("begin"), "n", "ids")


def pack_mixture(
    docs: DataFrame, tokenizer_path: str, targets: dict[str | None, float] | None = None, length: int = WINDOW, end_id: int = END_ID, temperature: float = 1.0
) -> DataFrame:
    """Pieces of all documents: doc_id, source_queue, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset.

    targets: share of tokens by source. They hold while the queues last; sources not named share what is left of 1.
    Without targets the shares are those of the sources' tokens to the power of temperature.
    """
    rows = stage(tokenized(docs, tokenizer_path, end_id), "tokens")
    spark = docs.sparkSession
    parts = stage(rows.groupBy("part", "queue").agg(F.sum("n").alias("tokens")), "parts")
    totals, own = parts.groupBy("queue").agg(F.sum("tokens").alias("tokens")), targets is None and temperature == 1
    whole = totals.agg(F.sum("tokens")).first()[0] or 1
    totals = stage(weighted(totals, whole, targets, temperature), "totals")
    queue, tokens, weights = queues_of(totals, length, own)
    other, layout_of = len(queue), json.dumps(schedule(tokens, weights, length))
    numbers = spark.createDataFrame([(k, v) for k, v in queue.items()], "queue string, number int")  # at most length rows
    numbered = parts.join(F.broadcast(numbers), parts.queue.eqNullSafe(numbers.queue), "left").select(
        parts.part, parts.queue, "tokens", F.coalesce("number", F.lit(other)).alias("number")
    )
    before = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = numbered.where(F.col("number") < other)
    offsets = stage(own.select("part", "queue", "number", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")), "offsets")
    placed = rows.join(offsets, (rows.part == offsets.part) & rows.queue.eqNullSafe(offsets.queue)).select(
        "doc_id", rows.queue.alias("source_queue"), "number", (F.col("place") + F.col("base")).alias("begin"), "n", "ids"
    )
    if len(tokens) > other:
        left = numbered.where(F.col("number") == other).withColumnRenamed("queue", "q")
        shared = left.join(totals.select("queue", "weight"), F.col("q").eqNullSafe(F.col("queue"))).select("part", "queue", "tokens", "weight")
        placed = placed.unionByName(dealt(rows, shared, tokens[other], other))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout([tuple(x) for x in json.loads(layout_of)], length)
        for rows in small(batches, by="ids"):
            out = []
            for row, (number, begin, n, ids) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("number", "begin", "n", "ids")), strict=True)):
                full = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                out += [(row, start, size, full[4 * start : 4 * (start + size)], n, seq, offset) for start, size, seq, offset in layout.pieces(number, begin, n)]
            index, start, size, part, n, seq, offset = zip(*out, strict=True)
            index = pa.array(index, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(index), rows.column("source_queue").take(index), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(part, pa.binary()), pa.array(n, pa.int64()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())],
                ["doc_id", "source_queue", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(
        cut, "doc_id long, source_queue string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def query(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents") if docs is None else docs
    pieces = pack_mixture(docs, public_tokenizers.path("word_bpe_49k.json"), temperature=TEMPERATURE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source_queue")


SQL = None
