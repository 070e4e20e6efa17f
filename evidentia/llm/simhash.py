"""SimHash near-duplicates by deletion-variant signatures (operator 9).

A fingerprint has a bit set where more than half of the text's shingle hashes have it. Two fingerprints that differ in
at most four bits, cut into three segments, agree in one segment up to a single bit (three segments with two
differing bits each would make six). So every segment is indexed once for each of its bits with that bit wiped out:
two segments at most one bit apart share such a variant, and an equality of variants finds every link.

Equal fingerprints meet first, so a crowd of copies is a single entry of the index. The entries, 64 a fingerprint,
are sorted by variant; a task walks through sorted runs of equal variants and verifies distances with array
arithmetic. A run yields links that span its linked fingerprints, never all of its pairs: a fingerprint, once linked,
leaves the list of those still to be reached. A link is judged only in the first variant its two ends share, so each
link is found in one run. Connected components over the links are found by star steps on written tables.

Defined results: a null text is an empty text; a text without words has fingerprint zero, linked like any other; a
text of fewer words than a shingle is a shingle as a whole; repeated rows are documents of their own; a null doc_id
counts in its group but is never its id (a group of null ids only has a null id); an empty table gives an empty
result; other columns are ignored by the fingerprints and kept by drop_near_duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stage, table, texts_of
from .components import components

WORDS, BITS, SEED = 4, 4, 42
#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: list[int]) -> int:
    """Bits set in over half of the hashes, as an unsigned 64-bit number."""
    if not hashes:
        return 0
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _BIT_OF_BYTE for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = WORDS) -> int:
    parts = text.encode().lower().split()  # bytes: lower() changes A-Z only, split() cuts at \x20 and \x09-\x0d only
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(b" ".join(parts), SEED) if parts else 0
    join = b" ".join
    return majority([digest(join(x), SEED) for x in zip(*(parts[k:] for k in range(words)), strict=False)])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return texts_of(docs).mapInArrow(work, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(variant, fp), 64 rows a fingerprint: the number of the wiped bit above, the segment without it below."""
    rows = []
    for at, width in SEGMENTS:
        segment = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
        rows += [segment.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit))) + F.lit((at + bit) << 22) for bit in range(width)]
    return fps.select(F.explode(F.array(*rows)).alias("variant"), "fp")


def _judged_here(x: np.ndarray, bit: np.ndarray | int, most: int) -> np.ndarray:
    """Of differences x of fingerprints that share the variant without this bit: at most `most` bits, and no earlier variant shared."""
    ok = np.bitwise_count(x) <= most
    first = np.full(x.shape, 64, np.int64)
    for at, width in reversed(SEGMENTS):
        part = (x >> np.uint64(at)) & np.uint64((1 << width) - 1)
        place = np.where(part == 0, at, at + np.bitwise_count(np.maximum(part, 1) - np.uint64(1)).astype(np.int64))
        first = np.where(np.bitwise_count(part) <= 1, place, first)
    return ok & (first == bit)


def spanning(fps: np.ndarray, bit: int, most: int) -> list[tuple[int, int]]:
    """Links that connect what the links of one run connect. Every reached fingerprint is compared once with those not yet reached."""
    out, rest = [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = _judged_here(rest ^ one, bit, most)
            if near.any():
                out += [(int(one), int(x)) for x in rest[near]]
                queue += list(rest[near])
                rest = rest[~near]
    return out


#: Runs up to this length are compared all at once, at shifts 1, 2, ... along the sorted rows.
SHORT = 12


def links(fps: DataFrame, most: int = BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect everything within `most` differing bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(variant: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            fp = fp.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
            sizes = np.diff(np.r_[starts, len(variant)])
            size, bit, a, b = np.repeat(sizes, sizes), variant >> 22, [], []
            for shift in range(1, min(SHORT, int(sizes.max(initial=0)))):
                at = np.flatnonzero((variant[shift:] == variant[:-shift]) & (size[shift:] <= SHORT))
                at = at[_judged_here(fp[at] ^ fp[at + shift], bit[at], most)]
                a.append(fp[at])
                b.append(fp[at + shift])
            for s in np.flatnonzero(sizes > SHORT):
                if found := spanning(fp[starts[s] : starts[s] + sizes[s]], int(bit[starts[s]]), most):
                    found = np.array(found, np.uint64)
                    a.append(found[:, 0])
                    b.append(found[:, 1])
            one, two = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["a", "b"])

        left = [], []  # the last run may go on in the next batch
        for batch in batches:
            v, f = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(v):
                continue
            cut = 0 if v[0] == v[-1] else int(np.flatnonzero(v != v[-1])[-1]) + 1
            if cut or (left[0] and left[0][-1][-1] != v[0]):
                whole = [np.concatenate([*left[k], x[:cut]]) for k, x in enumerate((v, f))]
                yield judge(*whole)
                left = [], []
            left[0].append(v[cut:])
            left[1].append(f[cut:])
        if left[0]:
            yield judge(np.concatenate(left[0]), np.concatenate(left[1]))

    return variants(fps).repartition("variant").sortWithinPartitions("variant").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, most: int = BITS) -> DataFrame:
    """doc_id, fp, component_id for every document: the smallest doc_id that chains of links reach."""
    rows = stage(fingerprints(docs, words), "fingerprints")
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = stage(components(links(fps.select("fp"), most)), "roots")
    joined = fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(stage(named, "named"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, most: int = BITS) -> DataFrame:
    """The rows of docs that stay, one document of each component (the one with its id), with all their columns.

    Rows that share a doc_id share its fate; a row without a doc_id stays, as no decision can name it.
    """
    found, name = near_duplicates(docs, words, most), free_name(docs, "gone")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name))
    return docs.join(stage(gone, "gone"), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL = None
