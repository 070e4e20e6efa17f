"""Phrase collocation mining by Apriori level-wise passes (operator 12).

Pass k counts the phrases of k words of every language. It emits one only where both phrases of k - 1 words in it, the
one without its last word and the one without its first, are frequent. Frequent phrases are broadcast as a bitmap of
their hashes, of one size whatever the corpus: a phrase whose bits are set by others is counted in vain, and the count
at the end of its own pass settles it, so results never depend on the bitmap. Counts of a stretch of texts are summed
up in the task that reads it, by integer codes of its own words; Spark adds up what stretches found, keyed by language
and phrase as strings, so no two phrases are taken for each other.

A frequent phrase's parts are frequent, so the tables of the levels hold all counts that the scores need: every cut of
a candidate joins its two parts there. A candidate goes if a longer one that contains it is nearly as frequent; longer
candidates name their parts, so this is a join too.

Defined results: a null text is empty; a null language is `und`; repeated rows count each; ties in score go to the
higher count, then to the smaller phrase by bytes; an empty table gives an empty result; other columns are ignored. A
very long text is a stretch by itself and takes some forty bytes of a worker's memory for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stage, table

#: Least count of a phrase, its most words, phrases told of each language, and the percentage at which a longer one stands for it.
LEAST, LONGEST, TOP, COVERS = 30, 4, 2000, 80
#: Scores are shares of this.
SCALE = 2_000_000
#: Bits of the broadcast bitmap (16 MB), two for each frequent phrase; and bytes of text counted at once.
BITS, STRETCH = 1 << 27, 2 << 20
UNKNOWN = "und"

#: What ends a piece and what ends a word: fixed values.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(WORD_ENDS)], _KIND[list(PIECE_ENDS)] = 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes with their bits spread."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashed(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)


def phrase_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash of each (lang, phrase), the one that Stretch.rolling() gives to its places."""
    for batch in batches:
        words = pc.split_pattern(batch.column("phrase"), " ")
        size = pc.list_value_length(words).to_numpy()
        first, seed, plain = np.r_[0, np.cumsum(size)], hashed(batch.column("lang")), hashed(words.flatten())
        out = np.zeros(batch.num_rows, np.uint64)
        for j in range(size.max(initial=0)):  # the word at j of all phrases that have so many
            here = size > j
            out[here] = out[here] * _ODD + (seed[here] + plain[first[:-1][here] + j] * _ODD)
        yield pa.RecordBatch.from_arrays([pa.array(mixed(out).view(np.int64))], ["hash"])


class Stretch:
    """The words of some texts: a code for each occurrence, and where the next word belongs to the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw = texts.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind = _KIND[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        within = kind == 0
        first = np.flatnonzero(within & (begins[:-1] | np.r_[True, ~within[:-1]])) if len(data) else np.zeros(0, np.int64)
        last = np.flatnonzero(within & (begins[1:] | np.r_[~within[1:], True])) if len(data) else first
        ends = pa.py_buffer(np.r_[0, np.cumsum(last - first + 1)])
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, ends, pa.py_buffer(_LOWER[data[within]])]).dictionary_encode()
        piece = np.cumsum(begins[:-1] | (kind == 2))[first]
        self.follows = np.diff(piece) == 0 if len(first) else np.zeros(0, bool)
        text = np.searchsorted(offsets, first, "right") - 1
        tongue = langs.dictionary_encode()
        # a code for each pair of language and word
        key = pa.array(tongue.indices.to_numpy()[text].astype(np.int64) * max(1, len(words.dictionary)) + words.indices.to_numpy()).dictionary_encode()
        self.codes = key.indices.to_numpy().astype(np.int64)
        of_lang, of_word = np.divmod(key.dictionary.to_numpy(), max(1, len(words.dictionary)))
        self.langs, self.words = tongue.dictionary.take(pa.array(of_lang)), words.dictionary.take(pa.array(of_word))
        self.hashes = hashed(tongue.dictionary)[of_lang] + hashed(words.dictionary)[of_word] * _ODD if len(of_word) else np.zeros(0, np.uint64)

    def rolling(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on, wherever pieces end."""
        h = self.hashes[self.codes]
        n = max(0, len(h) - k + 1)
        out = h[:n].copy()
        for j in range(1, k):
            out = out * _ODD + h[j : n + j]
        return mixed(out)

    def phrases(self, k: int, frequent: np.ndarray | None) -> pa.RecordBatch:
        """lang, phrase, n: the phrases of k words, each with its number of places, if both of its parts may be frequent."""
        n = max(0, len(self.codes) - k + 1)
        here = np.ones(n, bool)
        for j in range(k - 1):
            here &= self.follows[j : n + j]
        if frequent is not None:
            parts = probed(frequent, self.rolling(k - 1))
            here &= parts[:n] & parts[1 : n + 1]
        at = np.flatnonzero(here)
        size, key, tables = len(self.words), np.zeros(len(at), np.int64), []
        room = 1
        for j in range(k):
            if room * max(1, size) >= 1 << 62:  # the codes so far are numbered anew
                coded = pa.array(key).dictionary_encode()
                key, room = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
                tables.append((j, coded.dictionary.to_numpy()))
            key, room = key * size + self.codes[at + j], room * max(1, size)
        counted = pa.array(key).value_counts()
        key, counts = counted.field(0).to_numpy(), counted.field(1)
        columns: list[np.ndarray] = []
        for j in reversed(range(k)):
            key, code = np.divmod(key, size) if size else (key, key)
            columns.insert(0, code)
            if tables and tables[-1][0] == j:
                key = tables.pop()[1][key]
        words = [self.words.take(pa.array(c)) for c in columns]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if k > 1 else words[0]
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(columns[0])), phrase.cast(pa.binary()), counts], ["lang", "phrase", "n"])

    def totals(self) -> pa.RecordBatch:
        """The number of words of each language, as rows without a phrase."""
        n = np.bincount(self.codes, minlength=len(self.words))
        names = pa.table({"lang": self.langs, "n": n}).group_by("lang").aggregate([("n", "sum")])
        columns = [names.column("lang").combine_chunks(), pa.nulls(names.num_rows, pa.binary()), names.column("n_sum").combine_chunks().cast(pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    most = np.uint64(bits - 1)
    return h & most, (h >> np.uint64(32)) & most


def probed(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have both of their bits in the bitmap of bytes."""
    a, b = places(h, 8 * len(bitmap))
    bit = lambda p: (bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
    return (bit(a) & bit(b)).astype(bool)


def bitmap_of(frequent: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the hashes of a level's phrases. The driver gets at most bits / 64 rows, however many phrases are frequent."""
    low, high = F.col("hash").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(bits - 1))
    place = frequent.select("lang", "phrase").mapInArrow(phrase_hashes, "hash long").select(F.explode(F.array(low, high)).alias("p"))
    slots = place.groupBy(F.shiftright("p", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("set")).toArrow()
    words = np.zeros(bits // 64, "<i8")
    words[slots.column("slot").to_numpy()] = slots.column("set").to_numpy()
    return words.view(np.uint8)


def level(docs: DataFrame, k: int, least: int, before: DataFrame | None, bits: int) -> DataFrame:
    """lang, phrase, f: the phrases of k words that occur `least` times; of the first level also the sums of all words, without a phrase."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(before.where("phrase is not null"), bits)) if before is not None else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value if shared else None
        for batch in small(batches, 1 << 20, STRETCH):
            some = Stretch(batch.column("text"), batch.column("lang"))
            yield some.phrases(k, frequent)
            if k == 1:
                yield some.totals()

    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    found = rows.mapInArrow(work, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return stage(found.where((F.col("f") >= least) | F.col("phrase").isNull()).withColumn("phrase", F.col("phrase").cast("string")), f"phrases-{k}")


def levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> list[DataFrame]:
    if bits < 64 or bits & (bits - 1) or bits > 1 << 32:
        raise ValueError("bits must be a power of two from 64 to 2^32")
    found: list[DataFrame] = []
    for k in range(1, longest + 1):
        found.append(level(docs, k, least, found[-1] if found else None, bits))
    return found


def scored(found: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, words, l, r, score: every candidate at its lowest-scoring cut."""
    whole = lambda dfs: (dfs[0] if len(dfs) == 1 else dfs[0].union(whole(dfs[1:])))
    parts = whole([t.where("phrase is not null").select("lang", "phrase", "f") for t in found])
    split = F.split("phrase", " ")
    candidates = whole([t.select("lang", "phrase", F.col("f").alias("a"), split.alias("w")) for t in found[1:]])
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    left, right = F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ")
    cuts = cuts.select("lang", "phrase", "a", F.size("w").alias("words"), "k", left.alias("left"), right.alias("right"))
    of = lambda side, name: parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr(f"(cast({SCALE} as decimal(38, 0)) * a) div (cast(l as decimal(38, 0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("words").alias("words"), lowest).select("lang", "phrase", "a", "words", "cut.l", "cut.r", "cut.score")


def covered(found: list[DataFrame], covers: int) -> DataFrame:
    """lang, phrase, longer: for what stands within longer candidates, the largest count of one."""
    out = None
    for k, t in enumerate(found[2:], 3):
        w = F.split("phrase", " ")
        inner = [F.array_join(F.slice(w, i + 1, n), " ") for n in range(2, k) for i in range(k - n + 1)]
        rows = t.select("lang", F.explode(F.array(*inner)).alias("phrase"), F.col("f").alias("longer"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covers: int = COVERS, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two to `longest` words."""
    if longest < 2:
        raise ValueError("phrases have two words at least")
    found = levels(docs, least, longest, bits)
    rows = scored(found)
    if longest > 2:
        rows = rows.join(covered(found, covers), ["lang", "phrase"], "left").where(f"longer is null or cast(longer as decimal(38, 0)) * 100 < cast(a as decimal(38, 0)) * {covers}")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = found[0].where("phrase is null").select("lang", F.col("f").alias("n"))
    return first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_LEVEL = "SELECT lang, array_to_string(w[i:i + {k} - 1], ' ') AS phrase, {k} AS k, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM p WHERE len(w) >= {k}) GROUP BY ALL"
SQL = f"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(x, '[ \\t]+'), lambda y: y <> '') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS x FROM d)),
g AS MATERIALIZED (SELECT * FROM ({" UNION ALL ".join(_LEVEL.format(k=k) for k in range(1, LONGEST + 1))}) WHERE f >= {LEAST}),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
s AS (SELECT c.lang, c.phrase, a, j, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * a) // (x.f + y.f) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
      JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, phrase, max(f) AS longer FROM (
      SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase
      FROM (SELECT lang, a AS f, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))) GROUP BY ALL),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b LEFT JOIN i USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100::HUGEINT * longer < {COVERS}::HUGEINT * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""
