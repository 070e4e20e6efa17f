"""Whose document is this: part names in front matter, makers, orderable parts, package codes, and text from outside made safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .packages import FAMILY, LEAST_GLUED, MOST_LEADS, outline_letters

LEAST_STEM = 3
#: Endings of company names.
COMPANY_ENDINGS = r"(\s*,?\s*\b(inc\.?|corp\.?|corporation|ltd\.?|llc|gmbh|semiconductors?|technologies|technology))+$"


def stems(part: Column) -> Column:
    """Ever shorter beginnings of a part number, letters and digits only, the longest first, each once."""
    key = F.upper(F.trim(part))
    cut = F.transform(F.sequence(F.length(key) - 1, F.lit(LEAST_STEM), F.lit(-1)), lambda n: T.alnum_fold(F.substring(key, F.lit(1), n)))
    return F.when(F.length(key) > LEAST_STEM, F.array_distinct(F.filter(cut, lambda s: F.length(s) >= LEAST_STEM))).otherwise(F.array().cast("array<string>"))


def names_part(front: Column, part: Column) -> Column:
    """Does front matter name a part: the whole number, punctuation aside, or a beginning of it that no letter or digit goes on after.

    A part of under three characters names anything: it cannot be told apart.
    """
    text, key = F.upper(F.coalesce(front, F.lit(""))), F.upper(F.trim(part))
    whole = F.contains(T.alnum_fold(text), T.alnum_fold(key))
    bounded = F.exists(stems(part), lambda s: F.rlike(text, F.concat(F.lit("(^|[^A-Z0-9])"), s, F.lit("([^A-Z0-9]|$)"))))
    return (F.length(key) < LEAST_STEM) | whole | bounded


def fetched_verdict(front: Column, part: Column, pages: Column, chars: Column, parsed: Column) -> Column:
    """no text, another document, ok but too small for a datasheet, or ok; what could not be parsed is let pass as unknown."""
    return (
        F.when(~parsed, "no text")
        .when(~names_part(front, part), "does not name the part")
        .when((pages <= 4) & (chars < 4000), "too small")
        .otherwise("ok")
    )


def maker_name(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(value)), COMPANY_ENDINGS, ""))


def maker_matches(value: Column, names: list[str], aliases: list[str]) -> Column:
    """Long names may stand within another, short ones must be the whole of it: ti is in connectivity."""
    own = maker_name(value)
    out = own.isin(aliases) if aliases else F.lit(False)
    for n in names:
        out = out | F.contains(own, F.lit(n))
    return F.coalesce(out, F.lit(False))


def claims(part: Column, maker: Column, rules: dict[str, dict]) -> Column:
    """The vendors that claim a part, by its maker's name or by the beginning of its number. rules: vendor -> names, aliases, prefixes (a pattern)."""
    of = lambda r: maker_matches(maker, r["names"], r["aliases"]) | F.coalesce(T.normalised_part(part).rlike(f"^({r['prefixes']})"), F.lit(False))
    return F.array_compact(F.array(*(F.when(of(r), F.lit(v)) for v, r in rules.items())))


def orderable_of(orderable: Column, base: Column) -> Column:
    """Is an orderable number a variant of a part: it begins with it, and no digit follows."""
    return F.startswith(orderable, base) & ~F.substring(orderable, F.length(base) + 1, F.lit(1)).rlike("[0-9]")


def orderable_rows(docs: DataFrame, key: str, text: str, part: str, row: str) -> DataFrame:
    """key, designator, family, leads: packages that an ordering table in the text lists for the part, each family and count once, the first.

    row: a pattern with the groups orderable, family, code and pins.
    """
    group = lambda k: F.regexp_extract_all(text, F.lit(row), F.lit(k))
    rows = docs.select(key, part, F.posexplode(F.arrays_zip(*(group(k).alias(n) for k, n in enumerate(("orderable", "family", "code", "pins"), 1)))).alias("nth", "r"))
    base, leads = F.upper(F.trim(part)), F.col("r.pins").try_cast("long")
    sound = (F.length(base) >= LEAST_STEM) & orderable_of(F.upper("r.orderable"), base) & F.col("r.family").rlike(rf"(?i)\b(?:{FAMILY})\b") & leads.between(LEAST_GLUED, MOST_LEADS)
    rows = rows.where(sound).select(key, "nth", F.concat(F.col("r.family"), F.lit(" ("), F.col("r.code"), F.lit(")")).alias("designator"), F.upper("r.family").alias("family"), leads.alias("leads"))
    first = Window.partitionBy(key, "family", "leads").orderBy("nth")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "nth")


def bracketed_code(name: Column) -> Column:
    """The short code in brackets, in capitals, or null."""
    found = F.upper(F.regexp_extract(name, r"\(([A-Za-z][A-Za-z0-9-]{0,7})\)", 1))
    return F.when(found != "", found)


def package_code(name: Column) -> Column:
    """The vendor's code in a package's name: in brackets where the family stands before them, else the first word; outline numbers by their letters."""
    spelt = F.translate(F.coalesce(name, F.lit("")), "_", " ")
    before = F.substring_index(spelt, "(", 1)
    first = F.upper(F.regexp_extract(spelt, r"^\s*([A-Za-z][A-Za-z0-9-]{0,7})\s*\(", 1))
    leading = F.when((first != "") & ~first.rlike(rf"^(?:{FAMILY})$"), first)
    code = F.when(before.rlike(rf"(?i)\b(?:{FAMILY})\b"), bracketed_code(spelt)).otherwise(F.coalesce(leading, bracketed_code(spelt)))
    return F.coalesce(outline_letters(code), code)


def declared_leads(counts: Column) -> Column:
    """The one lead count that a designator declares, or null where it declares none or several. counts: array of counts, nulls among them."""
    known = F.array_compact(counts)
    return F.when(F.size(known) == 1, known[0])


def devices_named(label: Column) -> Column:
    """Part numbers in a label: two letters or more, then a digit, five letters and digits in all; package families are no parts."""
    bare = F.regexp_replace(F.coalesce(label, F.lit("")), rf"(?i)\b(?:{FAMILY})\b", " ")
    tokens = F.transform(F.split(bare, "[^A-Za-z0-9-]+"), lambda x: F.regexp_replace(x, "^-+|-+$", ""))
    devices = F.filter(tokens, lambda x: x.rlike("^[A-Za-z]{2,}[0-9]") & (F.length(T.alnum_fold(x)) >= 5))
    return F.transform(devices, T.alnum_fold)


def is_this_part(label: Column, part: Column) -> Column:
    """Can a label be about a part: it names no device, or one that contains it or that it contains."""
    mine, named = T.alnum_fold(F.coalesce(part, F.lit(""))), devices_named(label)
    return (F.size(named) == 0) | (mine == "") | F.exists(named, lambda d: F.contains(d, mine) | F.contains(mine, d))


def printed_page(pages: DataFrame, wanted: DataFrame, key: str, page: str, text: str, printed: str) -> DataFrame:
    """key, printed, page: the one page whose footer prints a number ("page 3 of 9"); no row where none or several do."""
    footers = pages.select(key, page, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\bpage\s+([0-9]{1,6})\s+of\s+[0-9]+"), F.lit(1)))).alias("_n"))
    footers = footers.select(key, page, F.col("_n").cast("int").alias(printed)).distinct()
    return footers.join(wanted.where(F.col(printed) >= 1).distinct(), [key, printed]).groupBy(key, printed).agg(F.min(page).alias(page), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def neutralised(text: Column) -> Column:
    """Text from outside, unable to pass for the frame around it: invisible characters go first, then fences and page marks, then triple angles break."""
    out = F.regexp_replace(text, "[\u202a-\u202e\u2066-\u2069\u200b-\u200f\ufeff]", "")
    out = F.regexp_replace(out, r"(?i)<<<\s*(BEGIN|END)_UNTRUSTED_DATASHEET\s*>>>", "(removed)")
    out = F.regexp_replace(out, r"(?i)\[\[\s*PAGE\s+[0-9]+\s*\]\]", "(removed)")
    return F.regexp_replace(F.regexp_replace(out, "<(?=<<)", "<\u200b"), ">(?=>>)", ">\u200b")


def safe_part(value: Column) -> Column:
    return F.substring(F.regexp_replace(value, "[^A-Za-z0-9._/+-]", ""), 1, 64)


def safe_designator(value: Column) -> Column:
    """A designator keeps brackets and blanks, which tell packages apart; what could forge a frame goes."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(value, "[<>\\[\\]{}\"'`\\\\|\\x00-\\x1f]", ""), r"\s+", " ")), 1, 64)


def search_queries(part: Column, maker: Column, boosts: dict[str, str]) -> Column:
    """Queries for a part in the order in which to try them, each once. boosts: maker -> its site, searched first."""
    names = T.part_variants(part)
    whole, others = names[0], F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0)))
    say = lambda *words: F.concat_ws(" ", *words)
    plain = F.array(say(whole, F.lit("datasheet pdf")), say(whole, F.lit("filetype:pdf")), say(whole, F.lit("PDF")))
    more = F.flatten(F.transform(others, lambda v: F.array(say(v, F.lit("datasheet pdf")), say(v, F.lit("filetype:pdf")))))
    named = F.when(maker.isNull(), F.array().cast("array<string>")).otherwise(F.array(say(maker, whole, F.lit("datasheet pdf")), say(maker, whole, F.lit("pdf"))))
    site = F.array().cast("array<string>")
    for m, host in boosts.items():
        site = F.when(maker_name(maker) == m, F.transform(names, lambda v: say(F.lit("site:" + host), v, F.lit("datasheet")))).otherwise(site)  # noqa: B023
    return F.array_distinct(F.concat(site, named, plain, more))


def same_range(a: tuple[Column, Column], b: tuple[Column, Column], eps: float = 0.005) -> Column:
    """Both ends near; null if an end is unknown."""
    return (F.abs(a[0] - b[0]) <= eps) & (F.abs(a[1] - b[1]) <= eps)


def within(value: Column, low: Column, high: Column, eps: float = 0.005) -> Column:
    return (value >= low - eps) & (value <= high + eps)


def private_endpoint(url: Column) -> Column:
    """ok where a model's address lies inside: the opposite of a fetch. Else why not."""
    verdict = T.url_verdict(url)
    return F.when(verdict.isin("private", "internal"), "ok").when(verdict == "ok", "public").otherwise(verdict)


def prompt(part: Column, hint: Column, fields: list[str], pages: Column) -> Column:
    """The text a model is asked with: always the same for the same inputs. pages: array of (page, text)."""
    fenced = F.transform(pages, lambda p: F.concat(F.lit("[[PAGE "), p["page"].cast("string"), F.lit("]]\n"), neutralised(p["text"])))
    return F.concat_ws(
        "\n", F.concat(F.lit("Part: "), safe_part(part)), F.concat(F.lit("Package: "), F.coalesce(safe_designator(hint), F.lit("unknown"))),
        F.lit("Fields: " + ", ".join(fields)), F.lit("<<<BEGIN_UNTRUSTED_DATASHEET>>>"), F.array_join(fenced, "\n"), F.lit("<<<END_UNTRUSTED_DATASHEET>>>"),
    )
