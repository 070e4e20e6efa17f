"""Removal of repeated passages by a suffix array with bucket-pointer refinement (operator 7).

A byte goes if it lies in a stretch of LENGTH bytes that also starts in a document with a smaller doc_id. Suffixes are
sorted as in Schuermann and Stoye's algorithm, until LENGTH bytes are told apart: initial buckets by the first eight
bytes, then buckets of several suffixes are refined by sorting them on the bucket pointers of later offsets (8, 16 and
32 further on). A pointer is a bucket's place in the order, so a refined bucket's pointers can be used at once by the
buckets refined after it; buckets of one suffix are settled and not touched again. Suffixes that share LENGTH bytes lie
side by side in the end, and the smallest doc_id among them decides about them all.

Sorting all suffixes of a corpus would ship every byte many times, so three passes work on blocks of documents:

1. Every window of LENGTH bytes names an anchor, the 24-byte gram in it with the smallest hash; equal windows name
   equal anchors. Blocks send the hashes of their anchors, about one for 14 bytes, sorted and packed, to tasks by ranges
   of hashes, and get back one bit for each: does another block have it?
2. For anchors of several documents, blocks send the bytes their windows cover (50 to 76), each stretch once a block
   with its smallest doc_id, to tasks by ranges of anchor hashes. So all equal windows meet in one task, which sorts
   their suffixes as above and answers with one bit for each window.
3. Blocks mark the bytes, and give back spans and what is left.

A hash only chooses candidates; what is removed is decided on bytes. Blocks are compressed and written once; exchanges
carry packed blobs, never one row for a byte. Blocks and ranges grow with the root of the input beyond some ten GB, so
that a blob has BLOB bytes of text behind it and their number grows with the input only, up to MOST (some TB); beyond
that blobs shrink towards single anchors. Memory is bound by these sizes and the longest document. A passage that all
blocks have sends one stretch a block to one range.

Defined results: a null text is empty; texts shorter than LENGTH bytes lose nothing; a null doc_id counts as larger than
all others; rows with equal doc_id count as one document, so they do not remove each other's bytes; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare, stage, table, texts_of

LENGTH, GRAM = 50, 24
WINDOWS = LENGTH - GRAM + 1  # grams of a window
WIDEST = LENGTH + WINDOWS - 1  # bytes the windows of one anchor cover at most
#: Bytes of documents in a block, and bytes of documents for which there is one range of hashes: at least, and at most.
BLOCK, RANGE, MOST = 4 << 20, 3 << 20, 64 << 20
#: Bytes of documents behind a blob that a block sends to a range.
BLOB = 900
_SLICE = 1 << 19
#: Stretches whose suffixes are sorted at once, about; those of one anchor always are.
PART = 10_000
_LAST = np.iinfo(np.int64).max


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 3)


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), np.uint8)


def hashes(buf: np.ndarray) -> np.ndarray:
    """Of the gram at each place; the last GRAM - 1 places have none."""
    h, size = (buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    by_size = {}
    for _ in range(4):
        factor = np.uint64(pow(0xD6E8FEB86659FD93, size, 1 << 64))
        h = h[:-size] * factor + h[size:]
        size *= 2
        by_size[size] = h
    h = by_size[16][: len(buf) - 23] * np.uint64(pow(0xD6E8FEB86659FD93, 8, 1 << 64)) + by_size[8][16 : len(buf) - 7]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes one to one with these and spread evenly. Those of anchors, each the smallest of WINDOWS, crowd at the low end."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def anchors(buf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents one after another: hash and place of each anchor, its first and last window, its document's number."""
    ends = np.cumsum(sizes)
    found: list[tuple] = []
    for at in range(0, max(0, len(buf) - LENGTH + 1), _SLICE):  # windows at .. at + _SLICE
        part = buf[at : at + _SLICE + LENGTH - 1]
        if len(part) < LENGTH:
            break
        h = hashes(part)
        key = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)  # places fit into 20 bits: the leftmost of equals wins
        for step in (1, 2, 4, 8):
            key = np.minimum(key[:-step], key[step:])
        key = np.minimum(key[: len(key) - 11], key[11:])  # 16 and 11 more: 27 grams
        place = (key & np.uint64(0xFFFFF)).astype(np.int64)
        window = np.arange(len(place)) + at
        doc = np.searchsorted(ends, window, "right")
        ok = ends[doc] - window >= LENGTH
        window, doc, place = window[ok], doc[ok], place[ok]
        if not len(window):
            continue
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
        found.append((mixed(h[place[new]]), place[new] + at, window[new], window[np.r_[new[1:] - 1, len(window) - 1]], doc[new]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, *[np.int64] * 4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def blocks_of(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, n, ids, sizes, body: documents packed into blocks of about `block` bytes, in the order the tasks read them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, texts, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = np.array(list(map(len, texts)), np.int64)
            row = (part << 32) | number, held, np.array(ids, np.int64).tobytes(), sizes.tobytes(), zstandard.compress(b"".join(texts), 3)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["block", "n", "ids", "sizes", "body"])

        for batch in batches:
            for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                if texts and held + len(raw) > block:
                    yield flush()
                    number, texts, ids, held = number + 1, [], [], 0
                texts.append(raw)
                ids.append(_LAST if i.as_py() is None else i.as_py())
                held += len(raw)
        if texts:
            yield flush()

    return texts_of(docs).mapInArrow(work, "block long, n long, ids binary, sizes binary, body binary")


class Block:
    """A block's documents and anchors, made anew by each pass and always the same."""

    def __init__(self, row: dict, ranges: int):
        self.ids, self.sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        self.buf = unpack(row["body"])
        self.hash, self.place, self.first, self.last, self.doc = anchors(self.buf, self.sizes)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.place, self.first, self.last, self.doc = (x[order] for x in (self.hash, self.place, self.first, self.last, self.doc))
        self.id = self.ids[self.doc]
        self.ranges = ranges

    def by_range(self, hash_: np.ndarray) -> list[tuple[int, int, int]]:
        """(range, from, to) of sorted hashes: ranges split the hashes' upper 32 bits evenly."""
        number = (hash_ >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)
        cuts = np.r_[0, np.flatnonzero(number[1:] != number[:-1]) + 1, len(number)] if len(number) else np.zeros(1, np.int64)
        return [(int(number[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct upper 48 bits of the anchors' hashes, and for each anchor its place among them."""
        return np.unique(self.hash >> np.uint64(16), return_inverse=True)

    def candidates(self, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchors that another document may have. bits: of each distinct hash, whether another block has it.

        Returns the anchors, their stretches (rows of bytes, the first two the length and the anchor's place), the
        stretches that are sent, and for each anchor which of these it has. Equal stretches are sent once, with the
        smallest doc_id.
        """
        short, inverse = self.short()
        low, high = np.full(len(short), _LAST), np.full(len(short), -_LAST)
        np.minimum.at(low, inverse, self.id)
        np.maximum.at(high, inverse, self.id)
        chosen = np.flatnonzero(bits[inverse] | (low != high)[inverse])
        first, size = self.first[chosen], (self.last - self.first)[chosen] + LENGTH
        rows = np.zeros((len(chosen), WIDEST + 2), np.uint8)
        wide = np.lib.stride_tricks.sliding_window_view(np.r_[self.buf, np.zeros(WIDEST, np.uint8)], WIDEST)
        rows[:, 2:] = wide[first]
        rows[:, 2:][np.arange(WIDEST) >= size[:, None]] = 0
        rows[:, 0], rows[:, 1] = size, self.place[chosen] - first
        # of equal hashes first by stretch, then by doc_id
        kind = np.unique(np.ascontiguousarray(rows).view(f"V{WIDEST + 2}").ravel(), return_inverse=True)[1] if len(rows) else np.zeros(0, np.int64)
        order = np.lexsort((self.id[chosen], kind, self.hash[chosen]))
        new = np.r_[True, (kind[order][1:] != kind[order][:-1])] if len(order) else np.zeros(0, bool)
        sent = order[new]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return chosen, rows, sent, which


def _rows(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"range": pa.int32(), "block": pa.int64(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.binary())) for n, x in zip(names, zip(*found, strict=True) if found else [()] * len(names), strict=True)], names)


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows in runs of equal key; they come sorted by it. One run is held at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def refined(buf: np.ndarray, depth: int = LENGTH, part: int = 1 << 18) -> np.ndarray:
    """The starts of suffixes in the order of their first `depth` bytes, by bucket-pointer refinement.

    Of all suffixes of at least eight bytes; those of twice `depth` bytes, of which the caller sees to it, are in order.
    """
    n = len(buf) - 7
    code = np.zeros(n, np.uint64)
    for k in range(8):
        code = (code << np.uint64(8)) | buf[k : k + n].astype(np.uint64)
    order = np.argsort(code, kind="stable")
    pointer = np.full(n + depth, -1, np.int64)  # of each suffix its bucket's place; what lies behind the end comes first

    def place(which: np.ndarray, new: np.ndarray) -> None:
        """Buckets of order[which] begin where new says so."""
        pointer[order[which]] = which[np.maximum.accumulate(np.where(new, np.arange(len(which)), 0))]

    codes = code[order]
    place(np.arange(n), np.r_[True, codes[1:] != codes[:-1]] if n else np.zeros(0, bool))
    known = 8
    while known < depth:
        bucket = pointer[order]
        same = bucket[1:] == bucket[:-1]
        open_ = np.flatnonzero(np.r_[same, False] | np.r_[False, same])  # buckets of several suffixes
        ends = np.flatnonzero(np.diff(bucket[open_], append=-1)) + 1
        cuts = ends[np.flatnonzero(np.diff(ends // part, append=-1))]
        for which in np.split(open_, cuts[:-1]):  # whole buckets; later ones already see the pointers of earlier ones
            if not len(which):
                continue
            starts = order[which]
            own, later = pointer[starts], pointer[starts + known]
            by = np.lexsort((later, own))
            order[which] = starts[by]
            own, later = own[by], later[by]
            place(which, np.r_[True, (own[1:] != own[:-1]) | (later[1:] != later[:-1])])
        known *= 2
    return order


def sorted_buckets(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of the bucket of equal LENGTH bytes at each start, numbered in their order. buf has LENGTH bytes at each start."""
    if not len(starts):
        return starts
    rank = np.empty(len(buf) - 7, np.int64)
    rank[refined(buf)] = np.arange(len(rank))
    by = np.argsort(rank[starts], kind="stable")
    rows = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)[starts[by]]
    new = (rows[1:] != rows[:-1]).any(axis=1)  # what is sorted is compared once more, byte by byte
    bucket = np.empty(len(starts), np.int64)
    bucket[by] = np.r_[0, np.cumsum(new)]
    return bucket


def earlier(rows: np.ndarray, hash_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each stretch a mask of its windows: does the same window lie in a stretch with a smaller id?

    Stretches that are equal as a whole are one, with the smallest id; an anchor with one stretch only has no others to
    share a part with, so only anchors with several have their suffixes sorted.
    """
    _, one, kind = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    least = np.full(len(one), _LAST)
    np.minimum.at(least, kind, ids)
    count = rows[:, 0].astype(np.int64) - LENGTH + 1
    full = (np.int64(1) << count) - 1
    mask = np.where(least[kind] < ids, full, 0)
    anchor = np.unique(hash_[one], return_inverse=True)[1]
    many = np.flatnonzero(np.bincount(anchor)[anchor] > 1)
    many = many[np.argsort(anchor[many], kind="stable")]
    last = np.flatnonzero(np.diff(anchor[many], append=-1)) + 1  # where anchors end; several are sorted at once, PART stretches or little more
    cuts = last[np.flatnonzero(np.diff(last // PART, append=-1))]
    for part in np.split(many, cuts[:-1]):
        windows = count[one[part]]
        buf = np.r_[rows[one[part], 2:].ravel(), np.zeros(LENGTH, np.uint8)]
        owner = np.repeat(np.arange(len(part)), windows)
        begin = np.cumsum(windows) - windows
        bucket = sorted_buckets(buf, owner * WIDEST + np.arange(len(owner)) - begin[owner])
        if not len(bucket):
            continue
        low = np.full(int(bucket.max()) + 1, _LAST)
        np.minimum.at(low, bucket, least[part][owner])
        # back to all stretches: each compares its own id with its windows' smallest
        place = np.full(len(one), -1)
        place[part] = np.arange(len(part))
        mine = np.flatnonzero(place[kind] >= 0)
        k = place[kind[mine]]
        rep = np.repeat(np.arange(len(mine)), windows[k])
        at = np.arange(len(rep)) - np.repeat(np.cumsum(windows[k]) - windows[k], windows[k])
        hit = (low[bucket[np.repeat(begin[k], windows[k]) + at]] < ids[mine][rep]).astype(np.int64) << at
        mask[mine] = np.bincount(rep, weights=hit, minlength=len(mine)).astype(np.int64)
    return mask.astype(np.uint32)


def sizes_for(total: int) -> tuple[int, int]:
    """Bytes of a block and of a range for an input of so many bytes."""
    root = int((BLOB * total) ** 0.5) + 1
    return tuple(min(MOST, max(least, root)) for least in (BLOCK, RANGE))


def exchange(blocks: DataFrame, answers: DataFrame | None, send: Callable, reply: Callable, ranges: int, tasks: int) -> DataFrame:
    """block, answers: blocks send blobs to ranges of hashes, which reply to each. answers: what blocks know so far."""

    def sending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare(tokenizers=True)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield _rows([(r, row["block"], blob) for r, blob in send(Block(row, ranges), row)], ["range", "block", "blob"])

    def replying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare(tokenizers=True)
        for group in by_group(batches, "range"):
            blobs = reply([g["blob"] for g in group])
            yield _rows([(g["block"], g["range"], b) for g, b in zip(group, blobs, strict=True)], ["block", "range", "blob"])

    rows = blocks if answers is None else told(blocks, answers, tasks)
    sent = rows.mapInArrow(sending, "range int, block long, blob binary")
    replies = sent.repartition(tasks, "range").sortWithinPartitions("range", "block").mapInArrow(replying, "block long, range int, blob binary")
    return stage(replies.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "blob"))).alias("answers")), "answers")


def told(blocks: DataFrame, answers: DataFrame, tasks: int) -> DataFrame:
    """Blocks with their answers; a block without anchors has none. Both sides are dealt alike, to tasks whose number grows with the blocks."""
    return blocks.repartition(tasks, "block").join(answers.repartition(tasks, "block").hint("shuffle_hash"), "block", "left")


def _answered(row: dict, name: str, dtype, n: int) -> np.ndarray:
    blobs = [unpack(a["blob"]) for a in row[name] or ()]
    return np.concatenate(blobs).view(dtype) if blobs else np.zeros(n, dtype)


def send_hashes(block: Block, row: dict) -> Iterator[tuple[int, bytes]]:
    short = block.short()[0]
    for r, a, b in block.by_range(short << np.uint64(16)):
        gaps = np.diff(short[a:b], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
        yield r, pack(gaps.T)  # byte by byte: the upper ones are nearly all zero


def reply_known(blobs: list[bytes]) -> list[bytes]:
    lists = [np.cumsum(np.ascontiguousarray(unpack(b).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64) for b in blobs]
    values, inverse, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    known = (n > 1)[inverse]  # each block sends a hash once
    return [pack(x.astype(np.uint8)) for x in np.split(known, np.cumsum([len(x) for x in lists])[:-1])]


def send_stretches(block: Block, row: dict) -> Iterator[tuple[int, bytes]]:
    chosen, rows, sent, _ = block.candidates(_answered(row, "answers", np.uint8, len(block.short()[0])).astype(bool))
    hash_, ids = block.hash[chosen][sent], block.id[chosen][sent]
    for r, a, b in block.by_range(hash_):
        yield r, pack(np.array([b - a]), hash_[a:b].view(np.uint8).reshape(-1, 8).T, ids[a:b].view(np.uint8).reshape(-1, 8).T, rows[sent[a:b]])


def reply_earlier(blobs: list[bytes]) -> list[bytes]:
    parts = []
    for blob in map(unpack, blobs):
        n = int(blob[:8].view(np.int64)[0])
        hash_, ids = (np.ascontiguousarray(blob[8 + k * 8 * n : 8 + (k + 1) * 8 * n].reshape(8, n).T).view(t).ravel() for k, t in enumerate((np.uint64, np.int64)))
        parts.append((blob[8 + 16 * n :].reshape(n, WIDEST + 2), hash_, ids))
    mask = earlier(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    return [pack(x) for x in np.split(mask, np.cumsum([len(p[1]) for p in parts])[:-1])]


def removed(block: Block, row: dict) -> np.ndarray:
    """Of each byte of a block, whether it goes."""
    known = _answered(row, "answers", np.uint8, len(block.short()[0])).astype(bool)
    chosen, _, sent, which = block.candidates(known)
    mask = _answered(row, "masks", np.uint32, len(sent)).astype(np.int64)[which]
    first, size = block.first[chosen], (block.last - block.first)[chosen] + 1
    mask = np.where(block.id[chosen] > block.id[chosen][sent][which], (np.int64(1) << size) - 1, mask)  # an equal stretch is in this block
    change = np.zeros(len(block.buf) + 1, np.int32)
    for at in range(0, len(chosen), PART):
        part = slice(at, at + PART)
        rep = np.repeat(np.arange(len(chosen))[part], size[part])
        nth = np.arange(len(rep)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        starts = (first[rep] + nth)[(mask[rep] >> nth) & 1 == 1]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def without_repeats(docs: DataFrame, block: int | None = None, range_: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end in bytes; maximal runs that go), kept (binary: what is left) of every document."""
    total = texts_of(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block, range_ = block or sizes_for(total)[0], range_ or sizes_for(total)[1]
    blocks = stage(blocks_of(docs, block), "blocks")
    ranges = int(max(1, total // range_))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges // 8)
    known = exchange(blocks, None, send_hashes, reply_known, ranges, tasks)
    masks = exchange(blocks, known, send_stretches, reply_earlier, ranges, tasks).withColumnRenamed("answers", "masks")

    def marking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare(tokenizers=True)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = Block(row, ranges)
                gone, at, out = removed(block, row), 0, []
                for doc_id, size in zip(block.ids.tolist(), block.sizes.tolist(), strict=True):
                    own = gone[at : at + size]
                    edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                    spans = [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
                    out.append((None if doc_id == _LAST else doc_id, size, spans, block.buf[at : at + size][~own].tobytes()))
                    at += size
                kinds = pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "spans", "kept"])

    both = known.join(masks, "block", "left")  # blobs of bits and masks, small beside the blocks
    return told(blocks, both, tasks).mapInArrow(marking, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = None
