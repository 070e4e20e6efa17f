"""License scans, collocations and alignment against brute force on small rows and tables, and their results for odd rows."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import alignment, collocations, licenses

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {"doc": 1, "batch": "x", "hash": 2, "phrase": "p", "w": "w", "pairs": 3, "template": "t", "n": 4, "f": 5, "rank": 6, "i": 7}


def docs_of(spark, texts, langs=("en",)):
    return spark.createDataFrame([(k, t, langs[k % len(langs)], "s", 0) for k, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t", "one", "MIT License", "mit license " * 300, "the cat. sat on the mat " * 2000, "a" * 100_000, "é😀 ß x\x1cy ▁ z", "漢字 かな", "tab\tand\r\nnew\x0bline"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, short, very long, repeated rows, a null id, a null language, and columns named like those the operators use."""
    df = docs_of(spark, ODD, ("en", None, "de")).withColumns({c: F.lit(v) for c, v in CLASH.items()})
    return df.union(df.where("doc_id in (5, 6)")).union(df.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 11 license scans

UPPER = str.maketrans(licenses.UPPER, licenses.UPPER.lower())


def words_of(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER)) if w]


def scanned(text, templates=licenses.TEMPLATES, k=licenses.WORDS, similarity=licenses.SIMILARITY):
    """The result of one text without hashes, joins or votes: every template laid at every place."""
    w = words_of(text)
    base, every, score = [], set(), Fraction(0)
    for t in templates:
        tw = t.words
        size, run = len(tw), min(k, len(tw))
        own = defaultdict(set)
        for at in range(-size, len(w)):
            for j in range(size - run + 1):
                if 0 <= at + j and w[at + j : at + j + run] == tw[j : j + run]:
                    own[at] |= set(range(j, j + run))
        for at in own:
            near = set().union(*(js for x, js in own.items() if abs(x - at) <= t.slack(similarity)))
            score = max(score, Fraction(len(near), size))
            if t.exact and len(own[at]) == size:
                base.append((at, t.label))
                every.add(t.label)
            elif not t.exact and len(near) / size >= similarity - 1e-9:
                every.add(t.label)
    places = [a for a, _ in base]
    labels = ",".join(sorted({x for _, x in base}))
    return len(w), len(base), min(places, default=None), max(places, default=None), labels, ",".join(sorted(every)), float(score)


def results(rows):
    return [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in rows]


def changed(rng, words, how_often):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < how_often / 3 else [w, "odd"] if x < 2 * how_often / 3 else ["other"] if x < how_often else [w]
    return " ".join(out)


def test_license_scan_is_every_template_at_every_place(spark):
    rng = random.Random(3)
    texts = [None, "", "Under the MIT-License, MIT License and the Apache License!", "cc by cc by", "gnu general public licence", "GNU\nGeneral  Public, License cc-BY"]
    for t in licenses.TEMPLATES:
        for often in (0, 0.05, 0.15, 0.5):
            texts.append("so it is " * rng.randrange(9) + changed(rng, t.words, often) + " and all that" * rng.randrange(9))
        texts.append(" ".join(t.words[: len(t.words) // 2]) + " far away " * 40 + " ".join(t.words[len(t.words) // 2 :]))
    rows = licenses.license_scan(docs_of(spark, texts).repartition(3)).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.doc_id)] == list(range(len(texts)))
    for r in rows:
        assert results([r]) == [scanned(texts[r.doc_id])], texts[r.doc_id]


def test_license_scan_finds_changed_notices(spark):
    mit = max((t for t in licenses.NOTICES if t.label == "mit"), key=lambda t: len(t.words))
    shifted = [*mit.words[:20], "and", "so", *mit.words[20:45], *mit.words[47:]]  # two words put in, two left out
    half = mit.words[:30]
    rows = {r.doc_id: r for r in licenses.license_scan(docs_of(spark, [" ".join(shifted), " ".join(half), "a clean text of many words"])).collect()}
    assert rows[0].labels == "mit" and rows[0].n_base == 0 and rows[0].score >= 0.8
    assert rows[1].labels == "" and 0.3 < rows[1].score < 0.8
    assert rows[2].labels == "" and rows[2].score == 0


def test_license_spans(spark):
    text = "we said released under the mit license here and licensed under the apache license version 2 0 there"
    found = licenses.spans(licenses.hits(docs_of(spark, [text]), licenses.TEMPLATES)).where("coverage = 1").collect()
    assert {(r.label, r.begin, r.end) for r in found if not r.exact} == {("mit", 2, 7), ("apache-2.0", 9, 17)}
    assert {(r.label, r.begin, r.end) for r in found if r.exact} == {("mit", 5, 7), ("apache", 12, 14)}


def test_license_scan_odd_rows(spark, odd, none):
    want = [scanned(t) for t in [*ODD, ODD[5], ODD[6], ODD[6]] if t is None or len(t) < 50_000]
    got = results(r for r in licenses.license_scan(odd).collect())
    assert Counter(r for r in got) == Counter([*want, *[scanned(t) for t in ODD if t and len(t) >= 50_000]])
    assert licenses.license_scan(none).count() == 0
    assert licenses.license_scan(odd, []).agg(F.max("score")).first()[0] == 0
    with pytest.raises(ValueError):
        licenses.hits(none, [licenses.Template("x", "a b " * licenses.MOST_WORDS)] * 4)


# 12 collocations


def mined(rows, least, longest, top, covers):
    """lang, rank, phrase, a, l, r, n, score by counting everything; rows: (text, lang)."""
    f, n, out = Counter(), Counter(), []
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    for lang in n:
        cands = {p[1:]: a for p, a in f.items() if p[0] == lang and len(p) > 2 and a >= least}
        kept = []
        for p, a in cands.items():
            score, _, left, right = min((2_000_000 * a // (f[lang, *p[:k]] + f[lang, *p[k:]]), k, f[lang, *p[:k]], f[lang, *p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= covers * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def prose(rng, n, words):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "! "]) for _ in range(n))


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_collocations_are_counts_of_everything(spark, bits):
    """With 64 bits the bitmap is full and lets every phrase through: the results are the same."""
    rng = random.Random(7)
    words = ["New", "York", "city", "the", "of", "Éa", "éa", "x y", "naïve", "a", "b"]
    texts = [prose(rng, rng.randrange(80), words) for _ in range(90)] + ["New York city hall of the a. " * 9, None, ""]
    df = docs_of(spark, texts, ("en", "de", None)).repartition(4)
    got = rows_of(collocations.collocations(df, least=5, top=40, covers=60, bits=bits))
    assert got == mined([(r.text, r.lang) for r in df.collect()], 5, 4, 40, 60)
    assert len(got) == 120


def test_codes_are_numbered_anew_when_they_outgrow_a_long(monkeypatch):
    rng = random.Random(2)
    text = prose(rng, 4000, [f"w{k}" for k in range(70)])
    whole = collocations.Stretch(pa.array([text]), pa.array(["en"]))
    want = sorted(zip(*(whole.phrases(4, None).column(c).to_pylist() for c in ("phrase", "n")), strict=True))
    filler = " ".join(f"z{k}" for k in range(120_000))  # so many words that four codes don't fit
    large = collocations.Stretch(pa.array([text, filler]), pa.array(["en", "en"]))
    batch = large.phrases(4, None)
    got = sorted(x for x in zip(*(batch.column(c).to_pylist() for c in ("phrase", "n")), strict=True) if x[0].startswith(b"w"))
    assert got == want and len(large.words) ** 4 > 1 << 62


def test_collocation_scores_are_exact(spark):
    """Counts whose products pass 64 bits."""
    big = 6_000_000_000_000
    one = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1)], "lang string, phrase string, f long")
    two = spark.createDataFrame([("en", "a b", big - 7)], "lang string, phrase string, f long")
    r = collocations.scored([one, two]).first()
    assert r.score == 2_000_000 * (big - 7) // (2 * big + 1) and (r.l, r.r) == (big, big + 1)


def test_no_frequent_phrase_is_missed(spark):
    """Places of a text look up the hashes that the level's table was written with."""
    rng = random.Random(1)
    text = prose(rng, 3000, [f"wörd{k}" for k in range(90)]).lower()
    some = collocations.Stretch(pa.array([text, "x y z"]), pa.array(["en", "de"]))
    for k in (1, 2, 3):
        phrases = some.phrases(k, None)
        rows = [(la, p.decode()) for la, p in zip(*(phrases.column(c).to_pylist() for c in ("lang", "phrase")), strict=True)]
        bitmap = collocations.bitmap_of(spark.createDataFrame(rows[::2] + rows[1::2], "lang string, phrase string").repartition(3), 1 << 20)
        whole = some.rolling(k)
        inside = np.ones(len(whole), bool)
        for j in range(k - 1):
            inside &= some.follows[j : len(whole) + j]
        assert collocations.probed(bitmap, whole)[inside].all() and inside.any()
    assert collocations.probed(bitmap, np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.01


def test_collocations_odd_rows(spark, odd, none):
    got = rows_of(collocations.collocations(odd, least=30, top=2000))
    assert got == mined([(r.text, r.lang) for r in odd.collect()], 30, 4, 2000, 80) and got
    assert collocations.collocations(none).count() == 0
    assert rows_of(collocations.collocations(odd, longest=2)) == mined([(r.text, r.lang) for r in odd.collect()], 30, 2, 2000, 80)
    for bad in ({"longest": 1}, {"bits": 100}):
        with pytest.raises(ValueError):
            collocations.collocations(none, **bad)


# 13 alignment

A, B = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
STATS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def own():
    """A by the JSON vocabulary and another library, B by whole texts: encode(text) gives ids and bytes of each side."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        names = {v: k for k, v in json.load(f)["model"]["vocab"].items()}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    model = alignment.PieceTokenizer(B).model

    def piece(k):
        name = model.id_to_piece(k)
        return bytes([int(name[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", name) else name.replace("▁", " ").encode()

    def encode(text):
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        return a, [bytes(back[c] for c in names[k]) for k in a], b, [piece(k) for k in b]

    return encode


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at := at + len(t)))
    return out


def brute(texts, encode):
    """The rows of texts, from pairs of overlapping spans."""
    found, times = [], Counter()
    for text in texts:
        links, groups = [], []
        a, a_bytes, b, b_bytes = encode(text) if text else ([], [], [], [])
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
            found.append((0, 0, 0, [], ""))
            continue
        sa, sb, j = spans(a_bytes), spans(b_bytes), 0
        for i, (x, y) in enumerate(sa):
            while sb[j][1] <= x:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < y:
                links.append((a[i], b[k]))
                k += 1
        i = j = 0
        for cut in sorted({y for _, y in sa} & {y for _, y in sb}):
            ends = [next((n for n in range(at, len(s)) if s[n][1] == cut)) + 1 for at, s in ((i, sa), (j, sb))]
            groups.append(",".join(map(str, a[i : ends[0]])) + "|" + ",".join(map(str, b[j : ends[1]])))
            i, j = ends
        times.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, b), n in times.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, n, len(links), sum(times[x] == best[x[1]] for x in links), sum(times[x] for x in links), sha) for n_a, n_b, n, links, sha in found]


def stats(df):
    return Counter((r.doc_id, *(r[c] for c in STATS)) for r in df.collect())


def test_alignment_of_a_table(spark, own):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert stats(alignment.query(spark, SF)) == Counter((k, *row) for (k, _), row in zip(docs, brute([t for _, t in docs], own), strict=True))


def test_alignment_of_odd_characters(spark, own, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 200)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\r", "é", "ß", "ñ", "▁", "😀", "漢", "'s", "12", "...", "<s>", "<0x41>", "<|endoftext|>", "\x1c", "\x85", "\x00", "the", " the", "　", "­", " \n", "\n "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)] + [None, "", " ", "▁", "  x ", "same text"] + ["same text"] * 3
    got = stats(alignment.alignment(docs_of(spark, texts).repartition(3), A, B))
    assert got == Counter((k, *row) for k, row in enumerate(brute(texts, own)))


def test_remembered_stretches_may_go(own, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5000)
    rng, tool = random.Random(4), alignment.Aligner(A, B)
    for _ in range(6):
        texts = [" ".join(rng.choice(["alpha", "beta", "gammas", "delta9", "épsilon", "zêta"]) + str(rng.randrange(9)) for _ in range(30)) for _ in range(5)]
        found = tool.batch(pa.array(texts))
        want = brute(texts, own)
        assert [tuple(int(found[c][k]) for c in STATS[:4]) for k in range(5)] == [w[:4] for w in want] and found["groups_sha256"] == [w[6] for w in want]


def test_alignment_odd_rows(spark, odd, none, own):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert stats(alignment.alignment(odd, A, B)) == Counter((k, *row) for (k, _), row in zip(rows, brute([t for _, t in rows], own), strict=True))
    assert alignment.alignment(none, A, B).count() == 0
