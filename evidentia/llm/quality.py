"""Quality by random Fourier features over document statistics (operator 8).

About thirty statistics of a text (lengths, shares of kinds of characters, of repeated words and lines, and so on) are
standardised and mapped to random Fourier features, whose inner products approximate a Gaussian kernel. Each partition
sums its rows' products z z' and z y; the sums are added and the ridge equations solved on the driver, their size set
by the number of features and not by the number of rows. Isotonic regression on other labelled documents turns the
ridge score into the probability of quality 1.

All labelled rows outside the held-out fold count: three quarters of them, by a hash of doc_id, in the equations, the
rest in the calibration, which works on counts in BINS bins of the ridge score, so that its size is bounded too.

Defined results: a null text is an empty text, whose statistics are all zero; a null doc_id falls in no held-out fold
and has no label; a doc_id with several labels has quality 1 if one says so; null labels count as none; without labels
of both classes every score is the share of quality 1 (0 without any); statistics that are the same everywhere count as
zero; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table, texts_of
from .toxicity import fold, labelled

FEATURES, SEED, WIDTH, RIDGE, BINS = 256, 8, 0.12, 1e-3, 2000
THRESHOLD = 0.7

_KIND = np.zeros(256, np.uint8)  # of each byte: 0 control, 1 space, 2 newline, 3 digit, 4 lower, 5 upper, 6 non-ASCII, 7 on: punctuation
_KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[48:58], _KIND[97:123], _KIND[65:91], _KIND[128:] = 1, 2, 3, 4, 5, 6
for _k, _chars in enumerate((b".", b",;:", b"!?", b"#$%&*@^~", b"|<>{}[]()_=+/\\", b"\"'`-")):
    _KIND[list(_chars)] = 7 + _k
_KINDS = 13


def statistics(text: str) -> list[float]:
    """All of a text's statistics, each of about the same size for short and long texts."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * STATISTICS
    n = len(raw)
    shares = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=_KINDS) / n
    words = raw.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    distinct = len(counts) / m
    most = max(counts.values(), default=0) / m
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
    same = sum(map(bytes.__eq__, words, words[1:])) / m
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    repeated = 1 - len(set(lines)) / k
    upper = sum(map(bytes.isupper, words)) / m
    ending = sum(w[-1:] in (b".", b"!", b"?") for w in words) / m
    odd = sum(not (w[-1:].isalnum() or w[-1:] in b".,;:!?" or w[-1] > 127) for w in words) / m
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(k), float(sizes.mean()), float(sizes.std()), math.sqrt(distinct * math.log1p(m)), distinct, most, pairs,
        same, repeated, upper, ending, odd, len(words) / k / (20 + len(words) / k), *(math.sqrt(x) for x in shares),
    ]


STATISTICS = 15 + _KINDS


def statistics_of(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column("text")], float).reshape(-1)
            x = pa.ListArray.from_arrays(np.arange(0, len(x) + 1, STATISTICS, dtype=np.int32), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], ["doc_id", "x"])

    return texts_of(docs).mapInArrow(work, "doc_id long, x array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), STATISTICS)


class Fourier:
    """Random features with z(x) z(y) near exp(-WIDTH^2 |x - y|^2 / 2) for standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.w = draw.normal(0, WIDTH, (STATISTICS, FEATURES))
        self.b = draw.uniform(0, 2 * math.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.c_[np.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b), np.ones(len(x))]


def ridge(rows: DataFrame, fourier: Fourier) -> np.ndarray:
    """Weights of the features: each partition sums its normal equations, in one row; their sums are added entry by entry."""
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = fourier(matrix(batch.column("x")))
            a += z.T @ z
            b += z.T @ batch.column("y").to_numpy(zero_copy_only=False)
        whole = np.r_[a[np.triu_indices(size)], b]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole), dtype=np.int32)), pa.array(whole)], ["k", "v"])

    found = rows.mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k").v.to_numpy()
    a = np.zeros((size, size))
    upper = np.triu_indices(size)
    a[upper] = found[:-size]
    a.T[upper] = found[:-size]
    n = max(1.0, a[-1, -1])  # the constant's square: the number of rows
    return np.linalg.solve(a + RIDGE * n / FEATURES * np.diag([1.0] * FEATURES + [1e-9]), found[-size:])


def isotonic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins at x with n rows, `ones` of them 1: knots and their probabilities, which never fall.

    Before pooling every bin gets its share of two rows more, one of each class, so that no probability is 0 or 1.
    """
    more = 1 / max(1, len(x))
    blocks: list[list[float]] = []
    for at, count, one in sorted(zip(x.tolist(), (n + 2 * more).tolist(), (ones + more).tolist(), strict=True)):
        blocks.append([at * count, count, one])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, ridge_score for every document."""
    rows = stage(statistics_of(docs), "statistics")
    known = labelled(labels, "quality", fold(F.col("doc_id"), folds) == held)
    known = stage(rows.join(known, "doc_id").select("doc_id", "x", F.col("y").cast("double").alias("y"), "h"), "labelled")
    n = {int(r.y): r["count"] for r in known.groupBy("y").count().collect()}
    held_out = (fold(F.col("doc_id"), folds) == held).alias("held_out")
    if len(n) < 2:
        share = n.get(1, 0) / max(1, sum(n.values()))
        return rows.select("doc_id", held_out, F.lit(share).alias("score"), F.lit(int(share >= threshold)).alias("predicted"), F.lit(0.0).alias("ridge_score"))
    about = known.select(*(f(F.col("x")[k]).alias(f"{f.__name__}{k}") for k in range(STATISTICS) for f in (F.mean, F.stddev_pop))).first()
    spread = np.array([about[f"stddev_pop{k}"] for k in range(STATISTICS)])
    fourier = Fourier(np.array([about[f"mean{k}"] for k in range(STATISTICS)]), np.where(spread > 1e-9, spread, np.inf))
    calibrating = F.pmod("h", F.lit(4)) == 0
    weights = ridge(known.where(~calibrating), fourier)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [c for c in batch.schema.names if c != "x"]
            score = fourier(matrix(batch.column("x"))) @ weights
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(score)], [*others, "ridge_score"])

    bin_ = F.floor(F.col("ridge_score") * (BINS / 4))  # ridge scores of 0/1 labels lie about 0 to 1
    bin_ = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), bin_))
    bins = known.where(calibrating).select("x", "y").mapInArrow(scores, "y double, ridge_score double").groupBy(bin_.alias("bin"))
    bins = bins.agg(F.avg("ridge_score").alias("x"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).toPandas()
    if bins.n.sum():
        knots, p = isotonic(bins.x.to_numpy(), bins.n.to_numpy(), bins.ones.to_numpy())
    else:
        knots, p = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def calibrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scores(batches):
            raw = batch.column("ridge_score").to_numpy()
            # between knots straight lines; a trace of the ridge score keeps different documents apart on the flat parts
            score = np.clip(np.interp(raw, knots, p) + 1e-9 * np.tanh(raw), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), batch.column("ridge_score")], ["doc_id", "score", "ridge_score"])

    found = rows.mapInArrow(calibrated, "doc_id long, score double, ridge_score double")
    return found.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "ridge_score")


def query(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = None
