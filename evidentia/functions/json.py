"""Reading JSON that a model wrote: complete, wrapped in prose, or cut short."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string, closed or cut off, or a bracket outside of strings; brackets with nothing between them.
_TOKEN, _PAIR = re.compile(r'"(?:[^"\\]|\\.)*+"?|[{}\[\]]', re.S), re.compile(r"\{\}|\[\]")


def closed(text: str) -> str | None:
    """A cut-off document up to the last bracket that closed, with those still open closed after it.

    Pairs of brackets are taken out from the inside until none is left; what remains must be opening ones, which are
    then closed in turn. None if no bracket ever closed, if nothing is open, or if the brackets do not match.
    """
    brackets = [m for m in _TOKEN.finditer(text) if m.group() in "{}[]"]
    while brackets and brackets[-1].group() in "{[":
        brackets.pop()
    left, before = "".join(m.group() for m in brackets), None
    while left != before:
        left, before = _PAIR.sub("", left), left
    if not left or set(left) & set("}]"):
        return None
    return text[: brackets[-1].end()] + left[::-1].translate(str.maketrans("{[", "}]"))


def object_in(text: str | None) -> str | None:
    """The JSON object in a text as compact JSON: from the first brace to the last, else repaired, else None."""
    start = (text or "").find("{")
    if start < 0:
        return None
    for attempt in (text[start : text.rfind("}") + 1], closed(text[start:])):
        try:
            if attempt and isinstance(found := json.loads(attempt), dict):
                return json.dumps(found, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            continue
    return None


def tolerant_object(text: Column) -> Column:
    """The JSON object in each text. What the engine reads stays there; only the rest goes to Python, in Arrow batches."""

    def objects(texts: pd.Series) -> pd.Series:
        return pd.Series([object_in(x) if isinstance(x, str) else None for x in texts], texts.index, object)

    whole = F.get_json_object(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "$")
    return F.coalesce(whole, F.pandas_udf(objects, "string")(F.when(whole.isNull() & F.contains(text, F.lit("{")), text)))


def enveloped(doc: Column, field: str) -> tuple[Column, Column]:
    """value and page of a field that is either bare or wrapped as {value, page}; a page that isn't a positive whole number is null."""
    raw = F.get_json_object(doc, f"$.{field}")
    wrapped = F.get_json_object(doc, f"$.{field}.value")
    page = F.get_json_object(doc, f"$.{field}.page").try_cast("int")
    return F.coalesce(wrapped, F.when(~F.startswith(raw, F.lit("{")), raw)), F.when(page > 0, page)


def positive_range(low: Column, high: Column) -> Column:
    """struct low, high of numbers as text, or null unless both are positive, finite and in order."""
    a, b = low.try_cast("double"), high.try_cast("double")
    return F.when((a > 0) & (b >= a) & (b < float("inf")), F.struct(a.alias("low"), b.alias("high")))
