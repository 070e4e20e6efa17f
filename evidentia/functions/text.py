"""String and identifier functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised_part(value: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(value)), r"[ \t\r\n]+", "")


def part_variants(value: Column) -> Column:
    """Ever broader names of a part, distinct, in the order in which they should be tried."""
    whole = normalised_part(value)
    stem = F.regexp_replace(whole, r"[0-9]{2}$", "")
    stem = F.when((stem != whole) & (F.length(stem) >= 5) & stem.rlike("[0-9]$"), stem).otherwise("")
    ladder = F.array(whole, F.regexp_replace(whole, "[-_].*$", ""), F.regexp_replace(whole, "^(.*[0-9])[A-Z]+[0-9]*$", "$1"), stem)
    return F.filter(F.array_distinct(ladder), lambda v: v != "")


def file_name(value: Column, fallback: str = "datasheet", longest: int = 128) -> Column:
    """A safe base name with the suffix .pdf."""
    base = F.regexp_replace(F.regexp_extract(value, r"([^/\\]*)$", 1), "[.][pP][dD][fF]$", "")
    clean = F.regexp_replace(F.regexp_replace(base, r"[\x00-\x1f]", ""), "[^A-Za-z0-9._-]+", "-")
    clean = F.regexp_replace(F.regexp_replace(clean, "-+", "-"), "^[-.]+|[-.]+$", "")
    return F.concat(F.substring(F.when(clean == "", fallback).otherwise(clean), 1, longest), F.lit(".pdf"))


def slug(value: Column, default: str = "part") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", default).otherwise(out)


def space_fold(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"[ \t\r\n]+", "")


def alnum_fold(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def pin_name_fold(value: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(value), "‐‑‒–—−", "------"), r"[ \t\r\n]+", "")


def words(value: Column) -> Column:
    """The text as one string of single-spaced words."""
    return F.trim(F.regexp_replace(value, r"[ \t\r\n]+", " "))


def letter_ratio(value: Column) -> Column:
    """ASCII letters among visible characters; null where there are none."""
    visible = F.length(F.regexp_replace(value, r"[ \t\r\n]", ""))
    return F.when(visible > 0, F.length(F.regexp_replace(value, "[^A-Za-z]", "")) / visible)


def looks_blocked(html: Column, markers: list[str], head: int = 4000) -> Column:
    start = F.lower(F.substring(html, 1, head))
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(start, F.lit(m))
    return out


#: What challenge pages say.
BLOCK_MARKERS = [
    "captcha", "unusual traffic", "are you a robot", "verify you are human", "automated queries", "access denied",
    "rate limit", "too many requests", "cf-browser-verification", "challenge-platform",
]
#: Hosts that never belong to a public address.
INTERNAL_HOSTS, INTERNAL_SUFFIXES = ["localhost", "metadata.google.internal", "metadata"], [".localhost", ".local", ".internal", ".localdomain"]


def private_ipv4(host: Column) -> Column:
    octets = F.transform(F.split(host, "[.]"), lambda o: o.try_cast("int"))
    a, b = octets[0], octets[1]
    valid = host.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$") & F.forall(octets, lambda o: o.between(0, 255))
    special = (a.isin(0, 10, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    return F.coalesce(valid & special, F.lit(False))


def private_ipv6(host: Column) -> Column:
    h = F.regexp_replace(F.lower(host), r"^\[|\]$", "")
    mapped = F.regexp_extract(h, r"^::ffff:([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    return h.isin("::1", "::") | h.rlike("^f[cd][0-9a-f]{2}:") | h.rlike("^fe[89ab][0-9a-f]:") | private_ipv4(mapped)


def url_verdict(url: Column) -> Column:
    """ok, or why a URL must not be fetched. Names are judged by themselves; addresses they resolve to are checked where the fetch is."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    internal = bare.isin(INTERNAL_HOSTS)
    for s in INTERNAL_SUFFIXES:
        internal = internal | F.endswith(bare, F.lit(s))
    return (
        F.when(scheme == "", "invalid")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(bare == "", "no_host")
        .when(internal, "internal")
        .when(F.when(F.contains(bare, F.lit(":")), private_ipv6(bare)).otherwise(private_ipv4(bare)), "private")
        .otherwise("ok")
    )


def usd(tokens_in: Column, tokens_out: Column, per_million_in: float = 0.3, per_million_out: float = 2.5) -> Column:
    return tokens_in * per_million_in / 1e6 + tokens_out * per_million_out / 1e6


def failure_kind(message: Column) -> Column:
    """Why a model call failed, by its message: the first rule that fits."""
    m = F.lower(message)
    return (
        F.when(m.rlike("spend(ing)? (cap|limit)|budget"), "cap")
        .when(m.rlike("credit|billing|payment"), "credits")
        .when(m.rlike("per ?day|daily"), "daily")
        .when(m.rlike("429|quota|rate limit"), "unnamed")
        .when(m.rlike("timeout|timed out|econn|503|502|unavailable"), "transient")
        .otherwise("permanent")
    )
