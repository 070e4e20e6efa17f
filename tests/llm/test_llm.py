"""Each operator against brute force on small rows, and its results for nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from evidentia.llm import components, decontamination, exact_dedup, packing, quality, repeats, simhash, surrogates, token_counts, tokens, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is it that was for on are with as at be this from by or an one not but all".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", ".", ","]) for _ in range(n))


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, short, very long, repeated, and columns named like those the operators use."""
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [None, "", " \n\t", "one", base, base, base.replace("the", "teh", 1), prose(rng, 30_000), "a" * 100_000, "é😀 ß\u00a0x\x1cy", base + " tail"]
    df = docs_of(spark, texts, digest="x", fp=1, kept="y", keep_id=2, hash=3, y=4, n=5, queue="q", place=6, __nth=0)
    return df.union(df.where("doc_id = 4")).union(df.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1 packing


def check_pieces(rows, docs, length=packing.WINDOW):
    """Every id of every document in one piece, sequences gapless, full or of a power of two, and the pieces' ids right."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or at & (at - 1) == 0
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_packing_holds_every_id_once(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = packing.query(spark, SF).collect()
    check_pieces(rows, docs)
    # while all queues last, every window has each source's share to the power of the temperature, within less than two tokens
    share, by = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in rows:
        share[r.source_queue] += r.length
        by[r.sequence_id][r.source_queue] += r.length
    total = sum(share.values())
    aim = {q: (n / total) ** packing.TEMPERATURE for q, n in share.items()}
    aim = {q: x / sum(aim.values()) for q, x in aim.items()}
    assert max(abs(aim[q] - share[q] / total) for q in aim) > 0.01  # another mixture than the corpus has
    lasting = int(min(share[q] / aim[q] for q in aim) // packing.WINDOW)
    assert lasting > 3 and all(abs(by[w][q] - packing.WINDOW * aim[q]) < 2 for w in range(lasting) for q in aim)


def test_targets_are_checked(spark):
    docs, path = docs_of(spark, ["a b c"]), public_tokenizers.path("word_bpe_49k.json")
    for targets in ({"a": 0.9, "b": 0.4}, {"a": -0.1}, {"a": 0.0}):
        with pytest.raises(ValueError):
            packing.pack_mixture(docs, path, targets)


def test_rare_sources_keep_their_targets(spark):
    """Sources owed less than two tokens a window share a queue, in the proportions of their targets: the first quarter of it shows them."""
    rows = [(k, "word " * 30, "en", ("a", "b", "c")[k % 3] if k < 90 else f"r{k % 4}", 0) for k in range(490)]
    aims = {"a": 0.5, "b": 0.3, "c": 0.14, "r0": 0.03, "r1": 0.015, "r2": 0.01, "r3": 0.005}
    found = packing.pack_mixture(spark.createDataFrame(rows, DOCS).coalesce(3), public_tokenizers.path("word_bpe_49k.json"), aims, length=32).collect()
    begin = {}
    for r in found:
        if r.start == 0 and r.source_queue.startswith("r"):
            begin[r.doc_id] = (r.sequence_id, r.offset, r.source_queue)
    first = [q for _, _, q in sorted(begin.values())][:120]
    assert len(begin) == 400 and all(abs(first.count(q) / 120 - aims[q] / 0.06) < 0.03 for q in ("r0", "r1", "r2", "r3"))


def test_packing_odd_rows(spark, odd, none):
    distinct = odd.dropDuplicates(["doc_id"])
    check_pieces(packing.query(spark, SF, distinct).collect(), [(r.doc_id, r.text) for r in distinct.collect()])
    assert packing.query(spark, SF, odd).agg(F.sum("length")).first()[0] > packing.query(spark, SF, distinct).agg(F.sum("length")).first()[0]
    assert packing.query(spark, SF, none).count() == 0


def test_packing_encodes_many_texts_at_once():
    batch = packing.pa.RecordBatch.from_arrays([packing.pa.array(["a word"] * 1024)], ["text"])
    assert [b.num_rows for b in packing.gathered(iter([batch] * 9))] == [4096, 4096, 1024]
    long = packing.pa.RecordBatch.from_arrays([packing.pa.array(["x" * (6 << 20)] * 3)], ["text"])
    assert [b.num_rows for b in packing.gathered(iter([long]))] == [1, 1, 1]


def test_packing_to_targets(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 150), "en", ("a", "b", None)[i % 3], 0) for i in range(90)]
    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack_mixture(spark.createDataFrame(rows, DOCS), path, {"a": 0.6, "b": 0.3}, length=64).collect()
    first = [r for r in found if r.sequence_id < 40]
    by = defaultdict(int)
    for r in first:
        by[r.source_queue] += r.length
    assert abs(by["a"] / 64 / 40 - 0.6) < 0.01 and abs(by["b"] / 64 / 40 - 0.3) < 0.01
    assert sum(r.length for r in found) == sum({r.doc_id: r.doc_tokens for r in found}.values())


def test_small_sources_keep_their_shares(spark):
    import public_tokenizers

    rows = [(5 * q + k, "the same few words in each text", "en", f"s{q}" if q else None, 0) for q in range(100) for k in range(5)]
    found = packing.pack_mixture(spark.createDataFrame(rows, DOCS).coalesce(3), public_tokenizers.path("word_bpe_49k.json"), length=64).collect()
    n, begin, sources, served = found[0].doc_tokens, {}, {}, {}
    for r in found:
        sources[r.doc_id] = r.source_queue
        served[r.doc_id] = served.get(r.doc_id, 0) + r.length
        if r.start == 0:
            begin[r.doc_id] = r.sequence_id * 64 + r.offset
    assert set(served.values()) == {n} and len(served) == 500
    by = {}
    for i in sorted(begin, key=begin.get):
        by.setdefault(sources[i], []).append(begin[i])
    full = 500 * n // 64 * 64  # the last, partial window is cut anew
    for places in by.values():  # each source's k-th document lies in the k-th fifth
        assert len(places) == 5 and all(100 * n * k <= p < 100 * n * (k + 1) for k, p in enumerate(places) if p < full)


def test_schedules_serve_all_tokens():
    rng = random.Random(2)
    for trial in range(60):
        totals = [rng.choice([rng.randint(1, 50), rng.randint(1, 3000)]) for _ in range(rng.randint(1, 6))]
        length = rng.choice([8, 16, 64])
        weights = list(totals) if trial % 2 else [rng.randint(1, 100) for _ in totals]
        while min(weights) * length < sum(weights):
            weights = [max(w, -(-sum(weights) // length)) for w in weights]
        layout, cells = packing.Layout(packing.schedule(totals, weights, length), length), set()
        for q, total in enumerate(totals):
            at = 0
            while at < total:
                n = min(total - at, rng.randint(1, 90))
                for _, size, seq, offset in layout.pieces(q, at, n):
                    new = {(seq, o) for o in range(offset, offset + size)}
                    assert not cells & new
                    cells |= new
                at += n
        assert len(cells) == sum(totals)


def test_other_tokenizers_encode_whole_texts():
    t = tokens.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert not t.by_word and t.encode_batch(["a b", "", "é x"]) == [t.whole(x) for x in ("a b", "", "é x")]


def test_forgotten_words_are_learnt_again():
    t, rng = tokens.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")), random.Random(9)
    t.words.limit = t.pieces.limit = 3000
    for _ in range(30):
        texts = [" ".join(rng.choice(["The", "x,", "y."]) + str(rng.randint(0, 50)) for _ in range(rng.randint(0, 20))) for _ in range(5)]
        assert t.encode_batch(texts) == [t.whole(x) for x in texts]
        assert t.words.held < 3000 + 100 * 250


def test_remembered_words_are_exact():
    t = tokens.word_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["", "it's <|endoftext|>x\x1cy", "Σας ΌΣΟΣ é İx 東京 ١٢\xa0b 'Tis don't''s %%'s5 ½²ª", "\x85\x0b a\n\n", "ﬁx ＡＢ", "a\u0301 e \u0301x"]
    assert t.by_word and t.encode_batch(odd * 2) == [t.whole(x) for x in odd] * 2


# 2 surrogates


def test_surrogates(spark, none):
    texts = [
        "Dear Mr. John Smith and Mrs Smith, call +1 (017) 555-7713. JOHN.DOE@MAIL.COM, john.doe@mail.com; 4111111111111111 10.0.0.1",
        "John Smith wrote to 10.0.0.1 and 10.0.0.2", None, "", "nothing here 1.2.3 or 12345", "Госпожа Анна Петрова; Frau Müller",
    ]
    df = docs_of(spark, texts, kind="k", canon="c")
    rows = {r.doc_id: r for r in surrogates.with_surrogates(df, "key").collect()}
    assert rows[2].text is None and rows[3].text == "" and rows[4].text == texts[4] and not rows[4].entities
    stand = {e.surface: e.stand_in for r in rows.values() for e in r.entities}
    assert set(stand) >= {"+1 (017) 555-7713", "4111111111111111", "10.0.0.1", "10.0.0.2", "Mrs Smith", "John Smith"}
    assert rows[0].text != texts[0] and not any(s in rows[0].text for s in stand if len(s) > 3)
    assert stand["JOHN.DOE@MAIL.COM"].lower() == stand["john.doe@mail.com"] and stand["JOHN.DOE@MAIL.COM"].isupper()
    assert stand["Mr. John Smith"] == "Mr. " + stand["John Smith"] and stand["John Smith"].split()[0] in surrogates.GIVEN["latin", "m"]
    assert stand["10.0.0.1"] != stand["10.0.0.2"] and stand["10.0.0.1"] in rows[1].text and stand["10.0.0.1"] in rows[0].text
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10
    assert luhn(stand["4111111111111111"]) == 0 and len(stand["4111111111111111"]) == 16
    shape = lambda s: "".join("9" if c.isdigit() else c for c in s)
    assert shape(stand["+1 (017) 555-7713"]) == shape("+1 (017) 555-7713")
    assert any("а" <= c <= "я" for c in stand["Госпожа Анна Петрова"][9:].lower())
    assert surrogates.with_surrogates(none, "key").count() == 0
    again = {r.doc_id: r.text for r in surrogates.with_surrogates(df, "key").collect()}
    other = {r.doc_id: r.text for r in surrogates.with_surrogates(df, "another").collect()}
    assert again == {i: r.text for i, r in rows.items()} and other[0] != again[0]


def test_surrogates_stay_distinct(spark):
    """A hundred addresses in a space of few forms: no two share a stand-in and none points at a real one."""
    texts = [f"mail {a}{b}@x.yz now" for a in "abcdefghij" for b in "0123456789"]
    rows = surrogates.with_surrogates(docs_of(spark, texts), "key").collect()
    real, fake = ({getattr(e, f).lower() for r in rows for e in r.entities} for f in ("surface", "stand_in"))
    assert len(real) == len(fake) == 100 and not real & fake


def test_surrogates_of_many_forms(spark):
    texts = [
        "id 123-45-6789, DE89 3704 0044 0532 0130 00 and 2001:db8::1 fe80:0:0:0:1:2:3:4",
        "+14155552671 or +49 30 12345678, 06 12 34 56 78, +33 1 23 45 67 89, 3782 822463 10005",
        "my name is Jennifer Miller, Dr. Chen, JOHN SMITH, MR. SMITH; 李伟先生 김민준 씨 Κύριος Παπάς السيد أحمد حسن; Γιάννης Παπάς",
        "std::vec a::b 12:30:45 :: 1.2.3 12345 2020-01-02 the name of the Rose",
    ]
    rows = {r.doc_id: r for r in surrogates.with_surrogates(docs_of(spark, texts), "key").collect()}
    stand = {e.surface: (e.kind, e.stand_in) for r in rows.values() for e in r.entities}
    assert {s: k for s, (k, _) in stand.items()} == {
        "123-45-6789": "id", "DE89 3704 0044 0532 0130 00": "iban", "2001:db8::1": "ipv6", "fe80:0:0:0:1:2:3:4": "ipv6", "+14155552671": "phone", "+49 30 12345678": "phone",
        "06 12 34 56 78": "phone", "+33 1 23 45 67 89": "phone", "3782 822463 10005": "number", "Jennifer Miller": "person", "Dr. Chen": "person", "JOHN SMITH": "person", "MR. SMITH": "person",
        "李伟": "person", "김민준": "person", "Κύριος Παπάς": "person", "السيد أحمد حسن": "person", "Γιάννης Παπάς": "person",
    }
    assert rows[3].text == texts[3]
    for s, (kind, new) in stand.items():
        assert new != s and not set(new.split()) & {w for w in s.split() if len(w) > 3 and w not in ("Κύριος", "السيد")}
        if kind != "person":
            assert [c if not c.isalnum() else "x" for c in s] == [c if not c.isalnum() else "x" for c in new]
    iban = stand["DE89 3704 0044 0532 0130 00"][1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    # a family name is one name wherever it stands
    assert stand["JOHN SMITH"][1].split()[-1] == stand["MR. SMITH"][1].split()[-1] and stand["Κύριος Παπάς"][1].split()[-1] == stand["Γιάννης Παπάς"][1].split()[-1]
    assert all(ord(c) > 0x4E00 for c in stand["李伟"][1]) and all("가" <= c <= "힣" for c in stand["김민준"][1])


def test_surrogates_take_odd_rows(spark, odd):
    """Very long texts, repeated rows, and columns named like those of the operator."""
    mail = docs_of(spark, ["x " * 50_000 + "a@b.cd", "a@b.cd"], e=1, entities="z", matches=2, hash=3, row=4)
    found = surrogates.with_surrogates(mail.union(mail), "key")
    rows = found.collect()
    assert found.columns == [*mail.columns, "entities_1"] and len(rows) == 4
    assert len({e.stand_in for r in rows for e in r.entities_1}) == 1 and all((r.e, r.entities, r.matches, r.hash, r.row) == (1, "z", 2, 3, 4) for r in rows)
    assert surrogates.with_surrogates(odd, "key").count() == odd.count()


def test_full_forms_are_an_error(spark):
    """All ten ids that a space of ten can have: none is left to stand in."""
    rows = spark.createDataFrame([("ipv6", str(d), None) for d in range(10)], "kind string, canon string, gender string")
    with pytest.raises(ValueError, match="no free stand-ins"):
        surrogates.ATTEMPTS, before = 3, surrogates.ATTEMPTS
        try:
            surrogates.stand_ins(rows, "key")
        finally:
            surrogates.ATTEMPTS = before


# 3 token counts


def test_token_counts(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer = token_counts.byte_tokenizer(path)
    found = token_counts.attributed(odd, path).collect()
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    for r in odd.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        text = r.text or ""
        own, n = by[r.doc_id], len(tokenizer.encoding.encode_ordinary(text))
        copies = 2 if r.doc_id == 4 else 1
        assert sum(s.tokens for s in own) == n * copies and len(own) == copies * len(text.splitlines(keepends=True) or [""]) if "\x1c" not in text and "\x85" not in text else own
    assert token_counts.attributed(none, path).count() == 0


def test_token_rules():
    rng = random.Random(3)
    t = token_counts.byte_tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for _ in range(100):
        raw = (text := "".join(rng.choice(["a", "the ", "\n", "\n\n", "é", "😀", " x"]) for _ in range(rng.randint(0, 30)))).encode()
        ends = t.ends(text)
        sections = np.array([*sorted(rng.randint(0, len(raw)) for _ in range(rng.randint(0, 5))), len(raw)])
        own = lambda b: next(i for i, e in enumerate(sections) if b < e)
        for rule in token_counts.RULES:
            want, start = np.zeros(len(sections)), 0
            for e in ends:
                o = [own(b) for b in range(start, e)]
                if rule == "share":
                    for q in o:
                        want[q] += 1 / len(o)
                else:
                    want[{"start": o[0], "end": o[-1], "most": max(sorted(set(o)), key=o.count)}[rule]] += 1
                start = e
            assert np.allclose(token_counts.attribute(ends, sections, rule)[0], want)


def test_fields_are_sections(spark):
    rows = spark.createDataFrame([(1, "héllo", None, "end")], "id long, a string, b string, c string")
    joined = token_counts.fields_joined(rows, "id", ["a", "b", "c"])
    found = token_counts.attributed(joined, public_tokenizers.path("byte_bpe_50k.tiktoken"), spans="cuts").orderBy("section").collect()
    assert [(r.start, r.end) for r in found] == [(0, 7), (7, 8), (8, 11)]


# 4 toxicity, 8 quality


def accuracy(found, labels, column):
    held = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 for r in found) and len(held) > 50
    return sum(p == y for p, y in held) / len(held)


def test_toxicity_is_learned(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    found = toxicity.query(spark, "/root/testdata/sf0.1").collect()
    assert len(found) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in found)
    held = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    caught = sum(p for p, y in held if y) / sum(y for _, y in held)
    spared = sum(1 - p for p, y in held if not y) / sum(1 - y for _, y in held)
    assert caught > 0.8 and spared > 0.98


def test_words_of_texts():
    long = "x" * 60
    texts = ["", "  ", "The cat's 3 Éá!", "我杀了你 ok", long + "badword " + long + "goodword", "_a_"]
    words, codes, ends = toxicity.words_of(toxicity.pa.array(texts))
    found = [[words[c] for c in codes[a:b]] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert found == [[], [], ["the", "cat", "s", "3", "éá"], ["我", "杀", "了", "你", "ok"], [long, "badword", long, "goodword"], ["a"]]


def brute_kneser_ney(texts, ys, every):
    """The models' log differences by the textbook: word after word, and words alone, for all pairs of words of the sample."""
    pairs = lambda t: list(zip(["", *t.split()], t.split(), strict=False))
    shared = defaultdict(int)
    for t in every:
        for _, w in set(pairs(t)):
            shared[w] += 1
    base = lambda w: (shared[w] + 1) / (sum(shared.values()) + len(shared) + 1)
    vocabulary = {w for t in texts for w in t.split()} | set(shared)
    counts = [defaultdict(int), defaultdict(int)]
    for t, y in zip(texts, ys, strict=True):
        for p in pairs(t):
            counts[y][p] += 1

    def discount(values):
        one, two = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return one / (one + 2 * two) if one and two else 0.5

    def model(c):
        follows, after = defaultdict(set), defaultdict(dict)
        for (u, w), n in c.items():
            follows[w].add(u)
            after[u][w] = n
        d1, d2, total = discount([len(x) for x in follows.values()]), discount(list(c.values())), len(c)
        alone = {w: max(len(follows.get(w, ())) - d1, 0) / total + d1 * len(follows) / total * base(w) for w in vocabulary}

        def bigram(u, w):
            n = sum(after[u].values()) if u in after else 0
            return alone[w] if not n else max(after[u].get(w, 0) - d2, 0) / n + d2 * len(after[u]) / n * alone[w]

        return alone, bigram

    (o, o2), (t, t2) = map(model, counts)
    return {w: np.log(t[w] / o[w]) for w in vocabulary}, {(u, w): np.log(t2(u, w) / o2(u, w)) for u in [*vocabulary, ""] for w in vocabulary}


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    staged, stage = {}, toxicity.stage
    monkeypatch.setattr(toxicity, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    n = 20_000
    docs = spark.range(n).selectExpr("id as doc_id", "if(id % 2 = 0, 'bad ', 'good ') || id % 7 as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 2 = 0 as int) as toxic")
    found = toxicity.toxicity(docs, labels)
    known = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(n))
    fitted, counts = staged["fitted"].count(), staged["counts"]
    assert fitted > known / 5 and counts.where("u is not null").selectExpr("sum(o + t)").first()[0] == 2 * (known - fitted)
    assert counts.where("u is null").selectExpr("sum(o + t)").first()[0] == 2 * (known - fitted)
    assert found.where("predicted != cast(doc_id % 2 = 0 as int)").count() == 0


def test_labelled_texts_are_those_of_a_join(spark):
    docs = spark.range(500).selectExpr("if(id % 50 = 7, null, id % 300) as doc_id", "'t' || id as text")
    known = spark.range(0, 600, 3).selectExpr("id as doc_id", "1 as y", "id as h")
    want = sorted(map(tuple, docs.join(known, "doc_id").select("doc_id", "y", "h", "text").collect()))
    for bits in (64, toxicity.BITS):
        assert sorted(map(tuple, toxicity.labelled_texts(docs, known, bits).collect())) == want and want


def test_vocabulary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "OWN", 3)
    monkeypatch.setattr(toxicity, "OTHERS", 4)
    words = toxicity.hashed([f"w{k}" for k in range(100)])
    shared = spark.createDataFrame([(int(w), 100 - k) for k, w in enumerate(words.view(np.int64))], "w long, s long")
    vocabulary, ids = toxicity.vocabulary_of(shared)
    known = vocabulary.words(words)
    assert (known[:3] == words[:3]).all() and len(set(known.tolist())) == 7
    want = defaultdict(int)
    for k, w in enumerate(known.view(np.int64).tolist()):
        want[w] += 100 - k
    assert {r.w: r.s for r in ids.collect()} == want
    assert len(set(vocabulary.contexts(words).tolist())) <= toxicity.CONTEXTS


def test_kneser_ney_equals_brute_force(spark):
    rng = random.Random(21)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice(["", "", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    ys = [rng.randint(0, 1) for _ in range(40)]
    alone, pairs = brute_kneser_ney(texts[:40], ys, texts)
    sample = spark.createDataFrame(list(zip(texts[:40], ys, strict=True)), "text string, y int").repartition(3)
    words, bigrams, unseen = toxicity.kneser_ney(toxicity.class_bigrams(sample), toxicity.shared_counts(docs_of(spark, texts)))
    judge = toxicity.Judge(toxicity.arrays(words), toxicity.arrays(bigrams), unseen)
    for text in ["a b c dx", "hx h", "a", *texts[40:]]:
        w = text.split()
        want = np.mean([pairs[p] for p in zip(["", *w], w, strict=False)]) if w else 0
        assert abs(judge(toxicity.pa.array([text]))[0][0, 0] - want) < 1e-4
    assert abs(toxicity.Judge(toxicity.arrays(words), toxicity.arrays(bigrams), unseen).l[judge.words(toxicity.hashed(["a"]))[0]] - alone["a"]) < 1e-5


def test_order_of_words_matters(spark):
    texts = [f"{x} kill {y} {k}" for k in range(30) for x, y in (("i", "you"), ("you", "i"))]
    labels = [int(t.startswith("i")) for t in texts]
    sample = spark.createDataFrame(list(zip(texts, labels, strict=True)), "text string, y int")
    words, bigrams, unseen = toxicity.kneser_ney(toxicity.class_bigrams(sample), toxicity.shared_counts(docs_of(spark, texts)))
    judge = toxicity.Judge(toxicity.arrays(words), toxicity.arrays(bigrams), unseen)
    toxic, ordinary = judge(toxicity.pa.array(["i kill you", "you kill i"]))[0][:, 0]
    assert toxic > 0.5 > -0.5 > ordinary


def test_lookup_finds_all():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.int64).astype(np.uint64) >> np.uint64(rng.integers(0, 50)))
    ask = np.r_[keys, keys + np.uint64(1)]
    got = toxicity.Lookup(keys)(ask)
    assert (got[: len(keys)] == np.arange(len(keys))).all() and all((g >= 0) == (a in set(keys.tolist())) for g, a in zip(got, ask.tolist(), strict=True))
    assert (toxicity.Lookup(keys[:0])(ask) == -1).all()


def test_quality_is_learned(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    found = quality.query(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in found)
    assert accuracy(found, labels, "quality") > 0.95


def test_most_frequent_word_is_of_the_whole_text():
    assert quality.statistics("a b c " + "stuffed " * 7)[7] == 0.7 and quality.statistics("a")[7] == 1 and quality.statistics(" ")[7] == 0


def test_learners_take_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (6, 0, 1), (7, 1, 0), (None, 1, 1), (8, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity, quality.quality):
        for docs, known in ((odd, labels), (odd, labels.where("false")), (none, labels), (odd, labels.where("doc_id = 6"))):
            found = f(docs, known).collect()
            assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)


def test_isotonic_is_the_least_squares_fit():
    """Pooling gives what the minimax formula gives: of all averages over stretches before and after."""
    rng = np.random.default_rng(0)
    for _ in range(20):
        x, n = np.sort(rng.random(15)), rng.integers(1, 9, 15)
        ones = rng.binomial(n, 0.5)
        knots, p = quality.isotonic(x, n, ones)
        assert (np.diff(knots) > 0).all() and (np.diff(p) >= 0).all() and (p > 0).all() and (p < 1).all()
        m, k = n + 2 / 15, ones + 1 / 15
        mean = lambda i, j: k[i : j + 1].sum() / m[i : j + 1].sum()
        want = [max(min(mean(i, j) for j in range(at, 15)) for i in range(at + 1)) for at in range(15)]
        distinct = lambda v: np.array(v)[np.flatnonzero(np.diff(v, prepend=-1) > 1e-9)]
        assert np.allclose(distinct(want), distinct(p))
    p = quality.isotonic(np.array([0.0, 1.0]), np.array([1000, 1]), np.array([900, 1]))[1]
    assert (np.diff(p) >= 0).all()


def test_ridge_equals_the_normal_equations(spark):
    rng = np.random.default_rng(2)
    x, y = rng.random((80, quality.STATISTICS)), rng.integers(0, 2, 80).astype(float)
    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y double").repartition(3)
    fourier = quality.Fourier(x.mean(axis=0), x.std(axis=0))
    z, size = fourier(x), quality.FEATURES
    want = np.linalg.solve(z.T @ z + quality.RIDGE * 80 / size * np.diag([1.0] * size + [1e-9]), z.T @ y)
    assert np.allclose(z @ quality.ridge(rows, fourier), z @ want, atol=1e-6)
    d = x[:5, None] - x[None, :5]
    kernel = np.exp(-(quality.WIDTH**2) * ((d / x.std(axis=0)) ** 2).sum(axis=2) / 2)
    assert np.abs((z[:5, :-1] @ z[:5, :-1].T) - kernel).max() < 0.3  # about the Gaussian kernel, with 256 features


# 5 exact duplicates


def test_exact_duplicates_heavy_and_light(spark, odd, none):
    rng = random.Random(7)
    texts = ["copy"] * 300 + [f"t{rng.randint(0, 150)}" for _ in range(400)] + [None, ""]
    df = docs_of(spark, texts)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    for one_in in (4, 64, 10_000):  # heavy: one, several, none
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df, one_in, 500).collect()} == want
        kept = exact_dedup.drop_duplicates(df, one_in, 500)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if w[2]}
    found = exact_dedup.exact_duplicates(odd).collect()
    same = [r for r in found if r.group_size == 4]
    assert len(same) == 4 and sum(r.kept for r in same) == 1 and {r.keep_id for r in same} == {5}
    assert sum(r.kept for r in found) == odd.select(F.coalesce("text", F.lit(""))).distinct().count() == exact_dedup.drop_duplicates(odd).count()
    assert exact_dedup.exact_duplicates(none).count() == exact_dedup.drop_duplicates(none).count() == 0


def test_heavy_rows_with_clashing_names_and_ties(spark):
    """A heavy group whose largest doc_id a third of its rows share, and columns named like those of the operator."""
    df = docs_of(spark, ["same"] * 300 + ["b"] * 2, keep="k", digest="d", nth=7, row=8, keep_id=9, last=1)
    df = df.union(df.where("doc_id = 299").crossJoin(spark.range(150).select()))
    kept = exact_dedup.drop_duplicates(df, 4, 500)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [299, 301]
    assert {(r.keep, r.digest, r.nth, r.row, r.keep_id) for r in kept.collect()} == {("k", "d", 7, 8, 9)}
    found = exact_dedup.exact_duplicates(df, 4, 500)
    assert found.where("kept").count() == 2 and found.where("group_size = 450").count() == 450


def test_repeated_rows_of_a_heavy_group(spark):
    df = docs_of(spark, ["same"] * 300 + ["b"])
    df = df.union(df.where("doc_id = 299"))
    assert exact_dedup.exact_duplicates(df, 4, 500).where("kept").count() == exact_dedup.drop_duplicates(df, 4, 500).count() == 2


def test_misra_gries_finds_all_heavy(spark):
    values = ["h"] * 60 + [f"v{i}" for i in range(100)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    found = {r.v: r.estimate for r in exact_dedup.misra_gries(df, 5).collect()}
    assert 60 - 160 / 6 <= found["h"] <= 60


# 6 WARC


def test_warc_round_trip(spark, none):
    pages = spark.createDataFrame(
        [(1, "http://a.test/x/", "<html><head><title>T &amp; t</title><meta name=d content='m'></head><body><script>x<b</script><p>One&nbsp;two<br>three <b>four</b></p><a href='../y?a=1&amp;b=2'>l</a><!-- no --></body></html>"),
         (2, None, None), (3, "http://b.test/\r\nX: y", "plain"), (4, "http://c.test/", "<p>" * 20_000)], "page_id long, url string, html string",
    ).withColumn("block", F.lit(1))
    made = warc.responses(pages)
    assert made.count() == 4
    whole = b"".join(r.warc for r in warc.serialize(made).orderBy("page_id").collect())
    files = spark.createDataFrame([(bytearray(whole),), (None,), (bytearray(whole[:100]),)], "content binary")
    back = warc.parse(files)
    key = lambda df: sorted((r.record_id, r.headers.rstrip(), bytes(r.block), r.payload_digest) for r in df.collect())
    assert key(back) == key(made)
    found = {(r.refers_to, r.record_type): r for r in warc.derivatives(back).collect()}
    by_page = {(r.page_id, r.record_type): r for r in warc.derivatives(made).collect()}
    assert len(by_page) == 8 and len({r.record_id for r in by_page.values()}) == 8
    for r in made.collect():
        for kind in ("metadata", "conversion"):
            d = by_page[r.page_id, kind]
            assert d.refers_to == r.record_id and d.payload_digest == r.payload_digest and f"WARC-Refers-To: {r.record_id}" in d.headers
            assert d.length == len(d.block) and d.block_digest == warc.digest(bytes(d.block)) and (r.record_id, kind) in found
    assert bytes(by_page[1, "conversion"].block).decode() == "One two\nthree four\nl"
    about = bytes(by_page[1, "metadata"].block).decode()
    assert '"Title": "T & t"' in about and '"absolute": "http://a.test/y?a=1&b=2"' in about
    assert by_page[2, "conversion"].length == 0 and "\nX: y" not in by_page[3, "metadata"].headers
    assert warc.derivatives(warc.responses(pages.where("false"))).count() == 0


def test_plain_text_of_broken_pages():
    text = warc.plain_text
    assert text("<html><head><title>T</title><body><p>Hello world") == "Hello world"
    assert text("a<svg><path>b<p>c") == "a b\nc" or text("a<svg><path>b<p>c") == "ab\nc"
    assert text("a<svg>x</svg>b<head>c") == "a bc" and text("<script>x") == "" and text("a < b <c") == "a < b <c"
    assert text("x<!-- y") == "x" and text("<p>1 &lt; 2</p>") == "1 < 2"
    for piece in ("<a ", "<meta ", "<!x ", "<svg>", "<script>", "<a b", "&", "<a " + "x" * 50):
        began = time.perf_counter()
        page = piece * (1_000_000 // len(piece))
        text(page), warc.about(page, "http://a.b/"), text(page + ">"), warc.about(page + ">", "")
        assert time.perf_counter() - began < 20, piece


def test_bodies_are_read_as_their_headers_say():
    import gzip

    def page(headers, body):
        block = b"HTTP/1.1 200 OK\r\n" + headers + b"\r\n\r\n" + body
        return warc.derived(1, "<id>", "http://a.b/", "WARC/1.0\r\nWARC-Concurrent-To:<1>\r\nWARC-Concurrent-To: <2>\r\n", block, None)

    text = lambda rows: rows[1][6].decode()
    assert text(page(b"Content-Type: text/html; charset=ISO-8859-1", b"<p>\xe9")) == "é"
    assert text(page(b"Content-Type: text/html\r\nContent-Encoding: gzip", gzip.compress(b"<p>x"))) == "x"
    assert text(page(b"Transfer-Encoding: chunked\r\nContent-Type: text/html", b"3\r\n<p>\r\n2;a=b\r\nhi\r\n0\r\n\r\n")) == "hi"
    assert text(page(b"Content-Type: text/html", b"<meta charset='iso-8859-1'><p>\xe9")) == "é"
    assert text(page(b"Content-Type: text/plain", b"a <b> c")) == "a <b> c"
    assert len(page(b"Content-Type: image/png", b"\x89PNG")) == 1
    assert '["WARC-Concurrent-To", "<1>"], ["WARC-Concurrent-To", "<2>"]' in page(b"", b"")[0][6].decode()


def test_long_files_are_read_in_linear_time():
    import gzip

    one = gzip.compress(b"WARC/1.0\r\nWARC-Type:response\r\nContent-Length: 20000\r\n\r\n" + random.Random(1).randbytes(20_000) + b"\r\n\r\n")
    began = time.perf_counter()
    found = list(warc.parse_bytes(one * 3000))
    assert len(found) == 3000 and {r[1] for r in found} == {"response"} and time.perf_counter() - began < 20
    assert len(list(warc.parse_bytes(one * 3 + one[: len(one) // 2]))) == 3
    plain = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r[6] for r in warc.parse_bytes(plain * 3)] == [b"abc"] * 3 and [r[6] for r in warc.parse_bytes(b"junk" + plain)] == [b"abc"]


# 7 repeated passages


def brute_repeats(rows):
    first, texts = {}, [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - 49):
            g = b[k : k + 50]
            first[g] = min(i, first.get(g, i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((None if i == (1 << 63) - 1 else i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def found_repeats(df, **sizes):
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in repeats.without_repeats(df, **sizes).collect()), key=repr)


def test_repeats_equal_brute_force(spark, odd, none):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_repeats([(r.doc_id, r.text) for r in df.collect()])
    assert sum(w[2] for w in want) > 1000
    assert found_repeats(df.repartition(3), block=30_000, range_=100_000) == want
    assert found_repeats(odd.repartition(2)) == brute_repeats([(r.doc_id, r.text) for r in odd.collect()])
    assert found_repeats(none) == []


def test_repeats_of_random_bytes(spark):
    rng = random.Random(11)
    stock = ["".join(rng.choice("ab") for _ in range(rng.randint(45, 70))) for _ in range(12)]
    texts = ["".join(rng.choice([*stock, "a" * rng.randint(1, 120), "ab" * 40, str(rng.random())]) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    df = docs_of(spark, texts).repartition(4)
    assert found_repeats(df, block=1500, range_=4000) == brute_repeats([(r.doc_id, r.text) for r in df.collect()])


def test_buckets_are_those_of_equal_bytes():
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    buf[1000:1300] = buf[100:400]
    starts = np.arange(0, 3000, 7)
    bucket = repeats.sorted_buckets(buf, np.r_[starts, starts + 900])
    strings = [buf[s : s + 50].tobytes() for s in np.r_[starts, starts + 900]]
    order = {g: k for k, g in enumerate(sorted(set(strings)))}
    assert [order[g] for g in strings] == bucket.tolist()


def test_refinement_sorts_suffixes():
    """Order and buckets after refinement against sorted(), on text with long repeats."""
    rng = np.random.default_rng(13)
    for size, alphabet in ((300, 2), (800, 3), (60, 1)):
        buf = rng.integers(97, 97 + alphabet, size).astype(np.uint8)
        buf[size // 2 : size // 2 + size // 4] = buf[: size // 4]
        padded = np.r_[buf, np.zeros(80, np.uint8)]
        whole, order = padded.tobytes(), repeats.refined(padded, 50, part=97)
        cut = [whole[s : s + 50] for s in order.tolist() if s < size]
        assert cut == sorted(whole[s : s + 50] for s in range(size)) and sorted(order.tolist()) == list(range(size + 73))


def test_ranges_get_even_shares():
    """Anchors are smallest hashes of their windows, and yet no range has many times its share of them."""
    buf = np.random.default_rng(5).integers(97, 123, 1 << 18).astype(np.uint8)
    row = {"ids": np.arange(4).tobytes(), "sizes": np.full(4, 1 << 16).tobytes(), "body": repeats.zstandard.compress(buf.tobytes())}
    block = repeats.Block(row, 20)
    shares = [b - a for _, a, b in block.by_range(block.hash)]
    assert len(shares) == 20 and max(shares) < 1.5 * len(block.hash) / 20


def test_sizes_grow_with_the_root():
    """The blobs between blocks and ranges grow with the input and not with its square, as far as MOST lets them."""
    for total in (1 << 29, 1 << 35, 1 << 40, 1 << 42):
        block, range_ = repeats.sizes_for(total)
        blobs = (total / block) * (total / range_)
        assert repeats.BLOCK <= block <= repeats.MOST and blobs <= 1.01 * max((total / repeats.BLOCK) * (total / repeats.RANGE) if total < 1 << 34 else 0, total / repeats.BLOB)


# 9 SimHash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    grams = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_components(fps, most):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    items = list(fps.items())
    for k, (i, a) in enumerate(items):
        for j, b in items[k + 1 :]:
            if (a ^ b).bit_count() <= most and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in fps}


def test_simhash_equals_brute_force(spark, odd, none):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in df.collect()}
    want = brute_components(fps, 4)
    assert len(set(want.values())) < len(want)
    found = simhash.near_duplicates(df).collect()
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in found} == {i: (fps[i], want[i]) for i in fps}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert all(r.component_id == 4 for r in got if r.doc_id in (4, 5, None))
    assert simhash.near_duplicates(none).count() == simhash.drop_near_duplicates(none).count() == 0


def test_links_connect_whatever_is_near(spark):
    """Chains and crowds of fingerprints, some in runs longer than the short path takes."""
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        g = f
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    want = brute_components(dict(zip(signed, [f % 2**64 for f in signed], strict=True)), 4)
    group = lambda m: {frozenset(k for k in signed if m.get(k, k) == r) for r in {m.get(k, k) for k in signed}}
    assert group(roots) == group(want)


def test_judged_once():
    rng = random.Random(6)
    for _ in range(500):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            b ^= 1 << bit
        x, hits = np.array([a ^ b], np.uint64), 0
        for at, width in simhash.SEGMENTS:
            mask = ((1 << width) - 1) << at
            for bit in range(at, at + width):
                if (a ^ b) & mask & ~(1 << bit) == 0:
                    hits += bool(simhash._judged_here(x, bit, 4)[0])
        assert hits == ((a ^ b).bit_count() <= 4)


# 10 decontamination


def brute_leaks(docs, items):
    import regex

    def shingles(text, n):
        w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
        n = n or min(5, len(w))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()

    out = {}
    for i, q in items:
        need = shingles(q, None)
        for d, t in docs:
            both = len(need & shingles(t, len(next(iter(need), "x"))))
            if need and both >= 0.8 * len(need) - 1e-9:
                out[d, i] = (both, len(need))
    return out


def test_leaks_equal_brute_force(spark, none):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.choice([1, 3, 5, 9, 20, 60, 200]))) for k in range(40)] + [(90, ""), (91, None), (92, "!!!")]
    texts = [None, "", *(prose(rng, 300) for _ in range(10))]
    for k in range(30):
        words = items[k][1].split()
        if k % 3 == 1 and len(words) > 8:
            words[len(words) // 2] = "changed"
        if k % 3 == 2 and len(words) > 8:
            words = words[: int(len(words) * 0.9)]
        texts.append(prose(rng, 100) + " " + " ".join(words).upper() + " " + prose(rng, 100))
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(list(enumerate(texts)), items)
    assert len(want) > 10
    found = decontamination.contained_items(docs, bench)
    assert {(r.doc_id, r.item_id): (r.matched, r.item_shingles) for r in found.collect()} == want
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.contained_items(none, bench).count() == decontamination.contained_items(docs, bench.where("false")).count() == 0


def test_leaks_take_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "a" * 100_000), (None, "one"), (2, "is it")], "item_id long, text string")
    rows = [(r.doc_id, " " + " ".join((r.text or "").lower().replace(".", " ").replace(",", " ").split()) + " ") for r in odd.collect()]
    long = {(i, q) for i, t in rows for q, s in ((None, " one "), (2, " is it ")) if s in t}
    assert len(long) > 2
    assert {(r.doc_id, r.item_id) for r in decontamination.contained_items(odd, bench).collect()} == {(8, 1), (3, None), *long}


def test_short_items_are_found_inside_documents(spark):
    docs = docs_of(spark, ["well, the Secret answer phrase is here", "secret answer", "phrase secret answer", "secret", "no"])
    bench = spark.createDataFrame([(1, "secret answer phrase"), (2, "secret"), (3, "is here")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs, bench).collect()}
    assert found == {(0, 1), (0, 2), (0, 3), (1, 2), (2, 2), (3, 2)}


def test_no_size_of_item_is_missed(spark):
    """Recall against exact containment, by the partition of the item's size: 1 in each."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 8, 9, 12, 17, 20, 33, 40, 70, 130, 300] * 3)]
    texts = []
    for k, t in items:  # up to a fifth of the shingles lost, at places of all kinds
        w = t.split()
        for _ in range(rng.randint(0, max(0, (len(w) - 4) // 25))):
            w[rng.randrange(len(w))] = "zzz"
        texts.append(" ".join([*(word() for _ in range(200)), *w, *(word() for _ in range(2000 if k % 5 == 0 else 20))]))
    want = brute_leaks(list(enumerate(texts)), items)
    found = {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == set(want) and {len(items[i][1].split()) for _, i in want} == {len(t.split()) for _, t in items}


# the pipeline


def test_pipeline_equals_its_parts(spark):
    """Each stage by brute force on its own input, except the learned one, whose decisions are taken from its operator."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic = {r.doc_id for r in toxicity.query(spark, SF).collect() if r.predicted}
    left = {i: t for i, t in docs.items() if i not in toxic}
    last = {}
    for i in sorted(left):
        last[left[i]] = i
    left = {i: left[i] for i in last.values()}
    left = {i: left[i] for i in set(brute_components({i: brute_fingerprint(left[i]) for i in sorted(left)}, 4).values())}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_leaks(list(left.items()), items)}
    want = {i: t for i, t in left.items() if i not in leaks}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(want) and len(leaks) > 0
    check_pieces(rows, list(want.items()))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, SF).columns == docs.columns


def test_filters_take_clashing_names_and_odd_rows(spark, odd, none):
    """Every stage of the pipeline on nulls, repeated rows, an empty table, and columns named like its own."""
    clashing = odd.withColumns({"gone": F.lit(1), "leak": F.lit(2), "digest": F.lit("d"), "keep": F.lit("k"), "nth": F.lit(3)})
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, clashing, SF)
        assert kept.columns == clashing.columns and kept.count() > 0, name
        assert {(r.gone, r.leak, r.digest, r.keep, r.nth) for r in kept.collect()} == {(1, 2, "d", "k", 3)}
        assert step(spark, none, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, SF).count() > 0 and corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0


def test_staged_tables_are_dropped(spark):
    from evidentia.llm import common

    before = common.drop_staged(spark)
    common.stage(spark.range(3).toDF("x"), "x")
    assert before >= 0 and common.drop_staged(spark) == 1 and common.drop_staged(spark) == 0


def test_sha_of_texts(spark):
    got = {r.doc_id: r.text_sha256 for r in exact_dedup.query(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect():
        assert got[r.doc_id] == hashlib.sha256(r.text.encode()).hexdigest()
