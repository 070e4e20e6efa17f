"""Cross-tokenizer alignment of a byte-level and a piece vocabulary (operator 13).

Each Arrow batch of texts is laid out as one run of bytes with the documents' offsets. The ends of both vocabularies'
tokens in it are counted once, by byte: a byte with one end bounds a link, a byte with two cuts a group. Running sums
over the bytes give every token its links and its group, and their differences at the documents' ends give each
document's counts. A link is a pair of tokens, one of each vocabulary, whose bytes overlap.

How often an id pair is linked in the whole corpus needs all documents: batches write the sums of their distinct pairs,
Spark adds them up and looks them up again batch by batch, so what travels is a batch's distinct pairs and never a row
for each link. A batch and its answers meet by the batch's number; no table of pairs is broadcast or collected.

Tokenizing works on distinct stretches of text: before a blank that follows a letter, digit or sign neither vocabulary
has a token across, so each such stretch is encoded once a batch and recent ones are remembered.

Defined results: a null or empty text, and one whose joined tokens differ from space+text, has no tokens: zeros and an
empty string; repeated rows are documents of their own; an empty table gives an empty result; other columns are
ignored. A very long text is a batch by itself and takes some fifty bytes of a worker's memory for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stage, table, texts_of
from .token_counts import byte_tokenizer

#: Bytes of text that are laid out at once, and those that remembered stretches and their ids may take in a worker.
BATCH_BYTES, REMEMBERED = 2 << 20, 64 << 20
#: What a remembered stretch takes besides its characters and ids, about.
ENTRY = 300
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class PieceTokenizer:
    """A piece vocabulary that adds a space in front: pieces(texts) and the bytes that each id stands for."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.blank = self.model.piece_to_id("▁")
        #: does no piece hold a blank after something else?
        self.by_stretch = not any("▁" in p.lstrip("▁") for p in names)

    def pieces(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space, which the model adds itself."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1) if texts else []
        return [ids or [self.blank] * (t == " ") for t, ids in zip(texts, found, strict=True)]


class Aligner:
    """Both tokenizers of a worker, with what it remembers of them."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_tokenizer(a_path), PieceTokenizer(b_path)
        self.n_a, self.n_b = len(self.a.sizes), len(self.b.bytes_of)
        self.b_sizes = np.array([len(x) for x in self.b.bytes_of], np.int64)
        #: how an id of A is written before another one of A and before its group's B, then the same of B and the next group
        names = [f"{k}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for k in range(n) for end in ends]
        self.written = pa.array([x.encode() for x in names], pa.large_binary())
        self.spelling = pa.array(self.b.bytes_of, pa.large_binary())
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.old: dict[bytes, tuple[bytes, bytes]] = {}
        self.held = 0

    def stretches(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where stretches begin that both tokenizers treat by themselves: at each text, and at blanks after a character that is surely no space."""
        first = np.zeros(len(data) + 1, bool)
        if self.b.by_stretch and len(data) > 2:
            before = data[1:-1]
            letter = (before > 0x20) & (before < 0x7F) | (before >= 0x80) & (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
            first[2:-1] = letter & (data[2:] == 0x20)
        first[starts] = True
        return np.flatnonzero(first)

    def ids_of(self, stretches: list[bytes]) -> list[tuple[bytes, bytes]]:
        """The ids of A and of B, as uint16 or uint32; of a stretch that B's tokens don't spell, none of B."""
        if self.held > REMEMBERED // 2:  # what was used lately stays
            self.old, self.known, self.held = self.known, {}, 0
        known, old, new = self.known, self.old, []
        for s in stretches:
            if s not in known:
                if (ids := old.get(s)) is None:
                    new.append(s)
                else:
                    known[s] = ids
                    self.held += ENTRY + 3 * len(s)
        if new:
            self.learn(new)
        return list(map(known.__getitem__, stretches))

    def learn(self, new: list[bytes]) -> None:
        texts = [s.decode("utf-8", "replace") for s in new]
        sizes = np.array(list(map(len, new)))
        parts = []
        for found, kind in zip((list(map(self.a.encoding.encode_ordinary, texts)), self.b.pieces(texts)), self.kinds, strict=True):
            n = np.array(list(map(len, found)))
            parts.append((np.fromiter(chain.from_iterable(found), kind, n.sum()), n))
        (a, n_a), (b, n_b) = parts
        # B spells a stretch if its tokens have the stretch's bytes, as many and the same
        of = np.repeat(np.arange(len(new)), n_b)
        wrong = np.bincount(of, self.b_sizes[b], len(new)) != sizes
        spelt = np.frombuffer(self.spelling.take(pa.array(b[~wrong[of]])).buffers()[2] or b"", np.uint8)
        raw = np.frombuffer(b"".join(s for s, w in zip(new, wrong.tolist(), strict=True) if not w), np.uint8)
        right = np.flatnonzero(~wrong)
        wrong[np.repeat(right, sizes[right])[spelt[: len(raw)] != raw]] = True
        cut = [np.r_[0, np.cumsum(n)] * k.itemsize for n, k in zip((n_a, n_b), self.kinds, strict=True)]
        a, b = a.tobytes(), b.tobytes()
        for s, bad, i, j, x, y in zip(new, wrong.tolist(), *(c[k : len(new) + k].tolist() for c in cut for k in (0, 1)), strict=True):
            self.known[s] = a[i:j], b"" if bad else b[x:y]
        self.held += ENTRY * len(new) + 3 * int(sizes.sum())

    @property
    def kinds(self) -> tuple[np.dtype, np.dtype]:
        return tuple(np.dtype("<u2" if n <= 65536 else "<u4") for n in (self.n_a, self.n_b))

    def batch(self, texts: pa.Array) -> dict[str, np.ndarray | list]:
        """Of texts that aren't empty: the counts, the digest of the groups, and sizes, pairs and counts of each text's distinct pairs."""
        wide = pa.large_string()
        spaced = pc.binary_join_element_wise(pa.scalar(" ", wide), texts.cast(wide), pa.scalar("", wide))
        data = np.frombuffer(spaced.buffers()[2], np.uint8)
        offsets = np.frombuffer(spaced.buffers()[1], np.int64, len(spaced) + 1, spaced.offset * 8)
        at = self.stretches(data[: offsets[-1]], offsets[:-1])
        cuts = np.r_[at, offsets[-1]]
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cuts.astype(np.int64)), spaced.buffers()[2]]).dictionary_encode()
        ids = self.ids_of(coded.dictionary.to_pylist())
        first = np.searchsorted(at, offsets)  # of each text's stretches
        spelt = np.array([bool(b) for _, b in ids])[coded.indices.to_numpy()] if ids else np.zeros(0, bool)
        wrong = np.diff(np.r_[0, np.cumsum(~spelt)][first]) > 0
        if wrong.any():
            return self.without(texts, wrong)
        (a, a_text), (b, b_text) = (self.taken([x[k] for x in ids], coded.indices, first, kind) for k, kind in enumerate(self.kinds))
        a_end, b_end = np.cumsum(self.a.sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.bincount(np.concatenate([a_end, b_end]), minlength=len(data) + 1)
        links, groups = np.cumsum(ends > 0), np.cumsum(ends == 2)
        # a token has as many links as ends of either side lie behind its own start, up to its own end
        key = np.repeat(a.astype(np.int64) * self.n_b, np.diff(links[a_end], prepend=0)) + np.repeat(b, np.diff(links[b_end], prepend=0))
        n_links = np.diff(links[offsets])
        n_groups = np.diff(groups[offsets])
        text = np.repeat(np.arange(len(texts)), n_links)
        both, counts = np.unique(text * (self.n_a * self.n_b) + key, return_counts=True)
        sizes = np.bincount(both // (self.n_a * self.n_b), minlength=len(texts))
        digests = self.digests(a, b, a_end, b_end, ends, groups, a_text + b_text)
        found = {"n_a": np.diff(a_text), "n_b": np.diff(b_text), "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests}
        return found | {"sizes": sizes, "pairs": both % (self.n_a * self.n_b), "counts": counts}

    def without(self, texts: pa.Array, wrong: np.ndarray) -> dict[str, np.ndarray | list]:
        """The same with zeros for texts that are spelt wrongly."""
        right = self.batch(texts.filter(pa.array(~wrong))) if not wrong.all() else {}
        place = np.flatnonzero(~wrong)
        found: dict = {"groups_sha256": [""] * len(texts)}
        for i, k in enumerate(place):
            found["groups_sha256"][k] = right["groups_sha256"][i]
        for c in (*COUNTS, "sizes"):
            found[c] = np.zeros(len(texts), np.int64)
            found[c][place] = right.get(c, 0)
        return found | {c: right.get(c, np.zeros(0, np.int64)) for c in ("pairs", "counts")}

    @staticmethod
    def taken(ids: list[bytes], indices: pa.Array, first: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and at which of them each text begins."""
        whole = pa.array(ids, pa.large_binary()).take(indices)
        at = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8) // kind.itemsize
        return np.frombuffer(whole.buffers()[2] or b"", kind, at[-1]), at[first]

    def digests(self, a, b, a_end, b_end, ends, groups, text_at) -> list[str]:
        """SHA-256 of each text's groups, written as `a1,a2|b1;a3|b2,b3`."""
        cuts = np.flatnonzero(ends == 2)
        a_upto, b_upto = np.searchsorted(a_end, cuts, "right"), np.r_[0, np.searchsorted(b_end, cuts, "right")]
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_upto[groups[a_end - 1]]] = 2 * a.astype(np.int64) + (ends[a_end] == 2)
        order[np.arange(len(b)) + a_upto[groups[b_end - 1]]] = 2 * (self.n_a + b.astype(np.int64)) + (ends[b_end] == 2)
        written = self.written.take(pa.array(order))
        at = np.frombuffer(written.buffers()[1], np.int64, len(written) + 1, written.offset * 8)[text_at].tolist()
        data = memoryview(written.buffers()[2])
        return [hashlib.sha256(data[x : y - 1]).hexdigest() for x, y in zip(at, at[1:], strict=False)]


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process, which the tasks it runs share."""
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a document: batch, doc_id, the counts, groups_sha256, its distinct pairs with their links; on a batch's first row also the batch's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        number = TaskContext.get().partitionId() << 40
        for batch in small(batches, 4096, BATCH_BYTES):
            texts = batch.column("text")
            filled = pc.greater(pc.binary_length(texts), 0)
            place = np.flatnonzero(filled.to_numpy(zero_copy_only=False))
            found = tool.batch(texts.filter(filled)) if len(place) else {}
            n = batch.num_rows
            columns = {c: np.zeros(n, np.int64) for c in (*COUNTS, "sizes")}
            digests = np.full(n, "", object)
            if found:
                digests[place] = found["groups_sha256"]
                for c, values in columns.items():
                    values[place] = found[c]
            pairs, counts = found.get("pairs", np.zeros(0, np.int64)), found.get("counts", np.zeros(0, np.int64))
            distinct, inverse = np.unique(pairs, return_inverse=True)
            sums = np.bincount(inverse, counts, len(distinct)).astype(np.int64) if len(pairs) else counts
            ends = np.r_[0, np.cumsum(columns["sizes"])]
            only_first = np.r_[0, np.full(n, len(distinct))]
            listed = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), batch.column("doc_id"), *(pa.array(columns[c]) for c in COUNTS), pa.array(digests, pa.string()),
                 listed(ends, pairs), listed(ends, counts), listed(only_first, distinct), listed(only_first, sums)],
                ["batch", "doc_id", *COUNTS, "groups_sha256", "pairs", "counts", "batch_pairs", "batch_counts"],
            )
            number += 1

    schema = ", ".join(["batch long, doc_id long", *(f"{c} long" for c in COUNTS), "groups_sha256 string", *(f"{c} array<long>" for c in ("pairs", "counts", "batch_pairs", "batch_counts"))])
    return texts_of(docs).mapInArrow(work, schema)


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """pair, count, best: links of each id pair in the whole corpus, and whether no pair of its B id has more. pair: A's id * n_b + B's id."""
    sums = rows.groupBy("pair").agg(F.sum("n").alias("count"))
    of_b = Window.partitionBy(F.col("pair") % n_b)  # an id has as many pairs as A has ids, however large the corpus
    return sums.withColumn("best", F.col("count") == F.max("count").over(of_b))


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row a document."""
    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    found = stage(aligned(docs, a_path, b_path), "aligned")
    zipped = F.explode(F.arrays_zip("batch_pairs", "batch_counts"))
    rows = found.select("batch", zipped.alias("z")).select("batch", F.col("z.batch_pairs").alias("pair"), F.col("z.batch_counts").alias("n"))
    counts = stage(pair_counts(rows, n_b), "pair-counts")
    answers = rows.select(F.col("batch").alias("asks"), "pair").join(counts, "pair")

    def looked_up(some: pa.Table, answer: pa.Table) -> pa.Table:
        pair, count, best = (answer.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pair)
        lists, times = (some.column(c).combine_chunks() for c in ("pairs", "counts"))
        at = order[np.searchsorted(pair, lists.flatten().to_numpy(), sorter=order)] if len(order) else order
        times = times.flatten().to_numpy()
        ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
        upto = lambda x: pa.array(np.diff(np.r_[0, np.cumsum(x)][ends]))
        return pa.table({**{c: some.column(c) for c in ("doc_id", *COUNTS)}, "n_best": upto(times * best[at].astype(np.int64)), "count_sum": upto(times * count[at]), "groups_sha256": some.column("groups_sha256")})

    few = found.select("batch", "doc_id", *COUNTS, "groups_sha256", "pairs", "counts")
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in (*COUNTS, "n_best", "count_sum")), "groups_sha256 string"])
    return few.groupBy("batch").cogroup(answers.groupBy("asks")).applyInArrow(looked_up, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return alignment(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.path("piece_bpe_32k.model"))


SQL = None
