"""Segmenting documents and cutting out what must not be cited."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What instructions hidden in a document look like.
INJECTIONS = [
    r"\b(ignore|disregard|forget|override)\b[^.\n]{0,40}\b(previous|prior|above|earlier|all)\b[^.\n]{0,40}\b(instruction|rule|prompt|direction)",
    r"\bnew\s+(rules?|instructions?|system\s+prompt)\s*:",
    r"\b(you\s+are\s+now|from\s+now\s+on|henceforth)\b[^.\n]{0,60}\b(report|answer|respond|return|output)",
    r"\b(system|assistant|user)\s*:\s*(the|you|ignore|new|this)",
    r"\b(respond|reply|answer|output)\b[^.\n]{0,30}\b(in\s+prose|without\s+json|instead\s+of)",
    r"\breport\s+\w+\s+as\s+\S+\s+for\s+(every|all|any)\b",
    r"\bdo\s+not\s+(follow|obey|apply)\b[^.\n]{0,30}\b(rule|instruction|format)",
]
REACH = 400


def prefix_budget(rows: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """Each key's rows up to the first that would break the budget; that one and all after it go."""
    upto = F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("used", upto).where(F.col("used") <= budget)


def skip_budget(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Each key's rows with `taken`: a row that would break the budget is left out and later, smaller ones still come in."""
    from .state import fold

    def step(used, values):
        fits = (used or 0) + values[0] <= budget
        return (used or 0) + (values[0] if fits else 0), (fits,)

    return fold(rows, [key], [order], step, [size], "taken boolean")


def islands(rows: DataFrame, keys: list[str], order: list[Column], breaks: Column, name: str) -> DataFrame:
    """Numbers the runs of each key, from 0; a run begins where breaks (which may look back with lag) is true."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = rows.withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("int"))
    return flagged.withColumn(name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_break")


def glyph_lines(glyphs: DataFrame, page: str, tolerance: float = 2.0, space: float = 0.2) -> DataFrame:
    """page, line, text, y: glyphs (x, y, width, height, str) from top to bottom; a line breaks where y falls by more than tolerance.

    Within a line glyphs run by x; a gap over `space` of the height puts a blank. Sorting by y first and by x within a
    line gives a total order, where a comparison with a tolerance would give none.
    """
    down = [F.col("y").desc(), F.col("x"), F.col("str")]
    w = Window.partitionBy(page).orderBy(*down)
    rows = islands(glyphs.withColumn("_drop", F.abs(F.lag("y").over(w) - F.col("y"))), [page], down, F.col("_drop") > tolerance, "line")
    across = Window.partitionBy(page, "line").orderBy("x", "str")
    end = F.lag(F.col("x") + F.col("width")).over(across)
    piece = F.concat(F.when(F.col("x") - end > space * F.col("height"), " ").otherwise(""), F.col("str"))
    rows = rows.withColumn("_piece", piece)
    ordered = F.array_sort(F.collect_list(F.struct("x", "str", "_piece")))
    return rows.groupBy(page, "line").agg(F.array_join(F.transform(ordered, lambda g: g["_piece"]), "").alias("text"), F.max("y").alias("y"))


def span_union(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and touching spans of each key as one."""
    before = F.max(end).over(Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    rows = islands(spans.withColumn("_before", before), [key], [F.col(start), F.col(end)], F.col("_before") < F.col(start), "_run")
    return rows.groupBy(key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def quarantine(texts: DataFrame, key: str, text: str, patterns: list[str] | None = None, reach: int = REACH, keep: bool = False) -> DataFrame:
    """key, regions, citable: spans around every match of a pattern, and the text without them. keep: with the text itself.

    Nearly all texts are clean and stay in the engine: Python gets what may match, by the same patterns without word
    ends, and nulls for all else, so that each text is searched once.
    """
    compiled = [re.compile(p, re.I) for p in patterns or INJECTIONS]

    def cut(value: str) -> tuple[int, str]:
        spans = sorted((max(0, m.start() - reach), min(len(value), m.end() + reach)) for p in compiled for m in p.finditer(value))
        joined: list[list[int]] = []
        for a, b in spans:
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        out, at = [], 0
        for a, b in joined:
            out.append(value[at:a])
            at = b
        return len(joined), "".join([*out, value[at:]])

    @F.pandas_udf("regions int, citable string")
    def cut_out(likely: pd.Series) -> pd.DataFrame:
        found = [(None, None) if x is None else cut(x) for x in likely]
        return pd.DataFrame({"regions": pd.array([n for n, _ in found], "Int32"), "citable": pd.array([t for _, t in found], "string")})

    likely = F.col(text).rlike("(?iu)" + "|".join(f"(?:{p})" for p in (patterns or INJECTIONS)).replace(r"\b", ""))
    rows = texts.select(key, text, cut_out(F.when(likely, F.col(text))).alias("_cut"))
    regions, citable = F.coalesce("_cut.regions", F.lit(0)), F.coalesce("_cut.citable", text, F.lit(""))
    return rows.select(key, *([text] if keep else []), regions.alias("regions"), citable.alias("citable"))


#: Labels of pin figures, which a wrong shift does not produce; white space, which a shift leaves as it is.
PIN_LABELS = r"\b(?:V(?:IN|OUT|CC|DD|SS|REF)|GND|ADJ|NC|OUT|IN|EN|CLK|SDA|SCL|RESET|TOP\s?VIEW|PIN)\b"
_WHITE = frozenset([9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
LOW, HIGH = 33, 126
#: Less of a text that is encoded are letters, and at least so much of what it decodes to.
ENCODED_BELOW, DECODED_LEAST = 0.4, 0.6


class Shift:
    """The constant offset of a text's characters, if one is clear, and the text without it."""

    def __init__(self, vocabulary: list[str] | str, shifts: range, min_hits: int, margin: int, low: int, encoded_below: float | None, decoded_least: float, any_case: bool = True):
        self.pattern = re.compile(vocabulary, re.A) if isinstance(vocabulary, str) else None
        self.words, self.any_case = list(vocabulary), any_case
        self.shifts, self.min_hits, self.margin, self.low, self.encoded_below, self.decoded_least = shifts, min_hits, margin, low, encoded_below, decoded_least
        self.tables: dict[int, tuple[dict[int, str], re.Pattern]] = {}

    def hits(self, text: str) -> int:
        if self.pattern:
            return sum(1 for _ in self.pattern.finditer(text))
        text = text.lower() if self.any_case else text
        return sum(text.count(w.lower() if self.any_case else w) for w in self.words)

    def apply(self, text: str | None, by: int) -> str | None:
        """The text with all but white space moved by so much; null if any character would leave the printable range."""
        if by not in self.tables:
            inside = [c for c in range(max(self.low - by, 0), HIGH - by + 1) if c not in _WHITE]
            kept = "".join(f"\\U{c:08x}" for c in (*inside, *_WHITE))
            self.tables[by] = {c: chr(c + by) for c in inside}, re.compile(f"[^{kept}]")
        table, outside = self.tables[by]
        return None if text is None or outside.search(text) else text.translate(table)

    def detect(self, text: str | None) -> int | None:
        codes = np.frombuffer((text or "").encode("utf-32-le"), "<u4")
        counts = np.bincount(np.minimum(codes, 0x10000), minlength=0x10001)
        counts[list(_WHITE)] = 0
        seen = np.flatnonzero(counts)
        if not len(seen):
            return None
        first, last, visible = int(seen[0]), int(seen[-1]), int(counts.sum())

        def letters(by: int) -> float:
            return sum(counts[max(a - by, 0) : max(b - by + 1, 0)].sum() for a, b in ((65, 90), (97, 122))) / visible

        if self.encoded_below is not None and letters(0) >= self.encoded_below:
            return None
        best, most = None, -1
        for by in self.shifts:
            if self.low <= first + by and last + by <= HIGH and letters(by) >= self.decoded_least and (n := self.hits(self.apply(text, by))) > most:
                best, most = by, n
        return best if most >= self.min_hits and most >= self.hits(text) + self.margin else None


def shift_decoded(
    rows: DataFrame, key: str, text: str, vocabulary: list[str] | str, shifts: range = range(1, 65), min_hits: int = 3, margin: int = 2,
    low: int = LOW - 1, encoded_below: float | None = None, decoded_least: float = DECODED_LEAST, any_case: bool = True,
) -> DataFrame:
    """key, shift, decoded: the shift of the whole text under which most known words occur, the first of equals; else null.

    A shift that takes any character out of low..126 is no candidate, nor one that leaves less than decoded_least of the
    visible characters letters. It must have min_hits occurrences, and margin more than the text as it stands.
    Texts of which encoded_below or more are letters are readable and not shifted, if that is given.
    vocabulary: words, found within others and, if so wished, in any case; or a regular expression.
    """
    shift = Shift(vocabulary, shifts, min_hits, margin, low, encoded_below, decoded_least, any_case)
    kind = rows.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [shift.detect(x) for x in f[text]]
            decoded = [None if by is None else shift.apply(x, by) for x, by in zip(f[text], found, strict=True)]
            yield pd.DataFrame({key: f[key], "shift": pd.array(found, "Int32"), "decoded": pd.Series(decoded, f.index, object)})

    return rows.select(key, text).mapInPandas(work, f"{key} {kind}, shift int, decoded string")


def shifted_fonts_decoded(items: DataFrame, keys: list[str], font: str, order: str, text: str) -> DataFrame:
    """items with the texts of shifted fonts decoded; keys name the document, order the place of an item in it.

    The font is the unit: all its items of a document, joined by blanks, show its shift. Items without a font, of
    readable fonts, and such as do not survive their font's shift stay as they are.
    """
    shift = Shift(PIN_LABELS, range(1, 65), 3, 2, LOW, ENCODED_BELOW, DECODED_LEAST)
    detect = F.pandas_udf(lambda s: pd.Series([shift.detect(x) for x in s], s.index, "Int32"), "int")
    apply = F.pandas_udf(lambda s, by: pd.Series([x if pd.isna(k) else (d if (d := shift.apply(x, int(k))) is not None else x) for x, k in zip(s, by, strict=True)], s.index, object), "string")
    named = items.where(F.col(text).rlike(r"\S") & (F.col(font) != ""))
    sample = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    fonts = named.groupBy(*keys, font).agg(sample.alias("_sample")).withColumn("_by", detect("_sample")).where("_by is not null")
    fonts = fonts.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, font])), "_by")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*keys, font])]
    rows = items.join(fonts, same, "left")
    return rows.withColumn(text, F.when(F.col("_by").isNotNull(), apply(text, "_by")).otherwise(F.col(text))).select(*items.columns)


def span_difference(spans: DataFrame, holes: DataFrame, keys: list[str], start: str = "start", end: str = "end", least: float = 0.0) -> DataFrame:
    """keys, start, end: what is left of each span without the holes of its keys; pieces not longer than least go.

    Holes that overlap or touch a span are cut to it and united; the gaps between them, and before and after, stay.
    """
    s = spans.withColumn("_a", F.col(start)).withColumn("_b", F.col(end)).select(*keys, "_a", "_b")
    h = holes.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    cut = s.join(h, keys).where((F.col("_s") < F.col("_b")) & (F.col("_e") > F.col("_a")))
    cut = cut.select(*keys, "_a", "_b", F.greatest("_s", "_a").alias("_s"), F.least("_e", "_b").alias("_e"))
    both = [*keys, "_a", "_b"]
    # an empty hole at either end of every span: gaps are then always between two holes
    edges = s.select(*both, F.col("_a").alias("_s"), F.col("_a").alias("_e")).union(s.select(*both, F.col("_b").alias("_s"), F.col("_b").alias("_e")))
    w = Window.partitionBy(*both).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.unionByName(edges).withColumn("_from", F.max("_e").over(w))
    return rows.where(F.col("_s") - F.col("_from") > least).select(*keys, F.col("_from").alias(start), F.col("_s").alias(end))


def superscripts_joined(lines: DataFrame, key: str, order: str, height: float = 0.85, rise: float = 0.7) -> DataFrame:
    """key, order, text, size, y: lines that are smaller than the next and only a little above it go before it, chains as a whole.

    lines: text, size (of its glyphs), y (of its base, growing upwards), in reading order.
    """
    w = Window.partitionBy(key).orderBy(order)
    below, size = F.lead("y").over(w), F.lead("size").over(w)
    small = F.coalesce((F.col("size") < height * size) & (F.col("y") - below > 0) & (F.col("y") - below <= rise * size), F.lit(False))
    rows = lines.withColumn("_small", small)
    rows = rows.withColumn("_g", F.coalesce(F.sum((~F.col("_small")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct(order, "text", "size", "y")))
    out = rows.groupBy(key, "_g").agg(parts.alias("_p"))
    last = F.element_at("_p", -1)
    return out.select(key, last[order].alias(order), F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("text"), last["size"].alias("size"), last["y"].alias("y"))


def best_pages(pages: DataFrame, key: str, page: str, text: str, pattern: str, most: int = 1) -> DataFrame:
    """key, page, hits: the pages with most matches of a pattern, of equals the shorter and then the earlier one; without any match the shortest."""
    rows = pages.select(key, page, F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("hits"), F.length(text).alias("_n"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col("hits").desc(), "_n", page))
    return rows.withColumn("_k", nth).where(F.col("_k") <= most).select(key, page, "hits")


def page_votes(items: DataFrame, page: str, most: int = 3) -> DataFrame:
    """page, votes: the pages that most items point to, the earlier of equals first."""
    return items.where(F.col(page).isNotNull()).groupBy(page).agg(F.count(F.lit(1)).alias("votes")).orderBy(F.col("votes").desc(), page).limit(most)
