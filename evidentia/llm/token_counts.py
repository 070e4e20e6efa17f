"""Token counts of sections by offset-mapped attribution (operator 3).

A document is encoded once, as a whole, so tokens are those a model would see and not those of texts cut apart. A
byte-level vocabulary gives every token's bytes, so running sums of their lengths are the tokens' spans, exactly. They
are joined to the document's sections as intervals, both sorted, by binary search. A token across a boundary goes to
sections by an explicit rule: to the one with its first byte ("start"), its last byte ("end"), most of its bytes
("most", the earlier one of equals), or to each by its share of the bytes ("share", as fractions). Whatever the rule,
a document's sections add up to its tokens.

Sections are a text's lines by default, each with its line end, or whatever spans a table gives, or the fields of a row
joined into one document. Spans must follow each other without gap or overlap: what they leave out at the end is a
section of its own.

Defined results: a null text is an empty text with a single empty section of no tokens; a null field counts as empty;
repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, texts_of

RULES = ("start", "end", "most", "share")
#: How byte-level vocabularies of this family cut texts before merging: fixed value, part of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteTokenizer:
    """encode(text) and the number of bytes of each token. Tokens of a byte-level vocabulary spell the text's bytes exactly."""

    def __init__(self, ranks_path: str, pattern: str = PATTERN):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in bytes."""
        ids = np.asarray(self.encoding.encode_ordinary(text), np.int64) if text else np.zeros(0, np.int64)
        return np.cumsum(self.sizes[ids])


@cache
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def attribute(ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by section, and how many of the tokens that touch a section cross one of its boundaries.

    ends: ends of tokens; sections: ends of sections, not falling, the last one at least the last token's end.
    """
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    k = len(sections)
    first = np.searchsorted(sections, starts, "right")  # the section with the token's first byte, empty sections passed over
    last = np.searchsorted(sections, ends - 1, "right")
    across = np.flatnonzero(first != last)
    touched = np.zeros(k, np.int64)
    whole = {"start": first, "end": last}.get(rule)
    counts = np.bincount(whole if whole is not None else np.delete(first, across), minlength=k).astype(float)
    for t in across:
        parts = np.arange(first[t], last[t] + 1)
        cuts = np.clip(np.r_[starts[t], sections[parts]], starts[t], ends[t])
        sizes = np.diff(cuts)
        touched[parts[sizes > 0]] += 1
        if rule == "most":
            counts[parts[np.argmax(sizes)]] += 1
        elif rule == "share":
            counts[parts] += sizes / (ends[t] - starts[t])
    return counts, touched


def line_ends(raw: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.r_[ends, len(raw)]


def attributed(docs: DataFrame, ranks_path: str, rule: str = "start", spans: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """doc_id, section, start, end (bytes of UTF-8), tokens, crossing, doc_tokens: one row for each section of each document.

    spans: a column of docs with the byte offsets at which sections end (array<long>); without it sections are lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    sections = F.col(spans).cast("array<long>") if spans else F.lit(None).cast("array<long>")
    rows = texts_of(docs, sections.alias("cuts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer(ranks_path, pattern) if pattern != PATTERN else byte_tokenizer(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some, found = batch.slice(at, 64), []
                for row, (text, cuts) in enumerate(zip(some.column("text").to_pylist(), some.column("cuts").to_pylist(), strict=True)):
                    raw = text.encode()
                    ends = line_ends(raw) if cuts is None else np.minimum(np.maximum.accumulate(np.array([c or 0 for c in cuts] or [0], np.int64)), len(raw))
                    if ends[-1] < len(raw):
                        ends = np.r_[ends, len(raw)]
                    tokens = tokenizer.ends(text)
                    counts, crossing = attribute(tokens, ends, rule)
                    n = len(ends)
                    found.append((np.full(n, row), np.arange(n), np.r_[0, ends[:-1]], ends, counts, crossing, np.full(n, len(tokens))))
                row, *columns = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(row)), *map(pa.array, columns)],
                    ["doc_id", "section", "start", "end", "tokens", "crossing", "doc_tokens"],
                )

    return rows.mapInArrow(work, "doc_id long, section long, start long, end long, tokens double, crossing long, doc_tokens long")


def fields_joined(rows: DataFrame, key: str, fields: list[str], between: str = "\n") -> DataFrame:
    """doc_id, text, cuts: the fields of each row joined into one text, each section a field with the separator after it."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    ends, whole = [], F.lit(0).cast("long")
    for k, p in enumerate(parts):
        whole = whole + F.octet_length(p) + (len(between.encode()) if k + 1 < len(parts) else 0)
        ends.append(whole)
    return rows.select(F.col(key).alias("doc_id"), F.concat_ws(between, *parts).alias("text"), F.array(*ends).alias("cuts"))


def query(spark, sf_dir: str) -> DataFrame:
    """Tokens of each line of every document; a token belongs where it starts."""
    import public_tokenizers

    found = attributed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.withColumn("tokens", F.col("tokens").cast("long"))


SQL = None
