"""Tokenizers on the executors: exact ids at a fraction of the cost, by encoding the distinct words of a batch once."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Bytes that the words and the pieces remembered by one worker may take, Python's own included. Results never depend on them.
WORD_BYTES, PIECE_BYTES = 64 << 20, 24 << 20
#: What an entry of a dictionary takes besides its key and value, about.
ENTRY = 170
#: Characters for which lower case, canonical composition and classes are the same in Python and in the tokenizer.
PLAIN = re.compile("[!-~¡-įı-ɏ]+")
#: How byte-level models write bytes: printable Latin-1 as it is, the others in order from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Space for Python and Arrow but not for the tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f]")


class Recent:
    """A dictionary of bounded size in two generations: what is used moves to the young one, and the old one goes when that is half full."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old, self.held = limit // 2, {}, {}, 0

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Those of the keys that are unknown. The others are young from here to the next call."""
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if (v := old.get(k)) is None:
                    out.append(k)
                else:
                    young[k] = v
                    self.held += ENTRY + len(k)
        return out

    def add(self, key: str, value: bytes) -> None:
        self.young[key] = value
        self.held += ENTRY + len(key) + len(value)


class WordTokenizer:
    """encode_batch(texts): the bytes of each text's ids, little-endian, uint16 if the vocabulary allows, else uint32.

    A tokenizer that drops white space and marks the ends of words encodes each word by itself, so the distinct words
    of a batch are encoded once and recent ones remembered, first as written, then as their lower-case pieces. Other
    tokenizers encode whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
        split = next((s for s in steps if s.get("type") == "Split" and s["behavior"] == "Removed" and s["invert"]), None)
        names = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = bool(split and spec["model"].get("end_of_word_suffix") and names == ["NFC", "Replace", "Lowercase"])
        if self.by_word:
            self.pieces_of = regex.compile(split["pattern"]["Regex"] + "|\n").findall
            self.added = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
            self.words, self.pieces = Recent(WORD_BYTES), Recent(PIECE_BYTES)
            self.id_bytes = [k.to_bytes(self.kind.itemsize, "little") for k in range(self.tokenizer.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode_batch(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_word or not len(texts):
            return [self.whole(x) for x in texts.to_pylist()]
        odd = np.flatnonzero(pc.match_substring_regex(texts, ODD_SPACE.pattern).to_numpy(zero_copy_only=False))
        split = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        ids = pa.array(self.learnt(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        # the words' ids lie one after another: texts are stretches between the ends of their last words
        sizes = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8) if len(ids) else np.zeros(1, np.int64)
        cuts = sizes[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        for k in odd.tolist():
            out[k] = self.whole(texts[k].as_py())
        return out

    def learnt(self, words: list[str]) -> list[bytes]:
        """The ids of each of these distinct words; of the empty word, none."""
        words_ = self.words
        if missing := words_.missing(words):
            plain = [w for w in missing if PLAIN.fullmatch(w)]
            if self.added.search("\n".join(plain)):
                plain = [w for w in plain if not self.added.search(w)]
            self.learn(plain)
            if len(plain) < len(missing):
                for w in set(missing).difference(plain):
                    words_.add(w, self.whole(w))
        return list(map(words_.young.__getitem__, words))

    def learn(self, words: list[str]) -> None:
        """Words of plain characters: cut all at once, and each new lower-case piece encoded once."""
        parts = self.pieces_of("\n".join(words).lower() + "\n") if words else []
        tokenize, id_bytes = self.tokenizer.model.tokenize, self.id_bytes
        for p in self.pieces.missing(set(parts)):
            ids = tokenize(p if p.isascii() else "".join(map(BYTE_CHARS.__getitem__, p.encode()))) if p != "\n" else ()
            self.pieces.add(p, id_bytes[ids[0].id] if len(ids) == 1 else b"".join([id_bytes[t.id] for t in ids]))
        at, one, piece = 0, [], self.pieces.young
        for p in parts:
            if p == "\n":
                self.words.add(words[at], one[0] if len(one) == 1 else b"".join(one))
                at, one = at + 1, []
            else:
                one.append(piece[p])


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, which the tasks it runs share, caches included."""
    return WordTokenizer(path)
