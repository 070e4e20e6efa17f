"""Pages of drawings: which page a place in the text is on, printed land patterns, package outlines, and which pages to ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packages import FAMILY, occurrences

c = F.col
#: Headings and marks of drawings, how far around a heading to look, and what makes a page a drawing.
LAND_HEADING, LAND_TITLE, DRAWING_HEADING = "LAND PATTERN EXAMPLE", "EXAMPLE BOARD LAYOUT", r"PACKAGE\s+OUTLINE|MECHANICAL\s+DATA|OUTLINE\s+DIMENSIONS|PACKAGE\s+DRAWING"
CALLOUT = r"(?:([0-9]{1,3})X\s*)?\(([0-9]{1,3}(?:\.[0-9]{1,3})?)\)"
BEHIND, AHEAD, CAPTION, CODE_REACH = 1200, 80, 60, 40
LEAST_VALUES, LEAST_COLUMNS, COLUMN, ALTERNATES = 8, 0.3, 6, 4
FRONT_PAGES, MOST_DESIGNATORS, MOST_PAGES = 3, 8, 16


def on_page(offsets: DataFrame, pages: DataFrame, key: str, offset: str) -> DataFrame:
    """offsets with `page`: the page a place in the text is on, the first that ends after it; places beyond the last have none.

    A point in a span: places and ends of pages lie in one order, and each place takes the next page's end.
    """
    ends = pages.select(key, c("end").alias("_at"), c("page").alias("_page"), F.lit(None).cast("long").alias(offset), F.lit(1).alias("_is_end"))
    points = offsets.select(key, (c(offset) + 1).alias("_at"), F.lit(None).cast("long").alias("_page"), c(offset).cast("long").alias(offset), F.lit(0).alias("_is_end"))
    order = Window.partitionBy(key).orderBy("_at", "_is_end").rowsBetween(0, Window.unboundedFollowing)
    return ends.unionByName(points).withColumn("page", F.first("_page", ignorenulls=True).over(order)).where("_is_end = 0").select(key, offset, "page")


def land_patterns(docs: DataFrame, key: str, text: str, family: str) -> DataFrame:
    """key, place, values: of each document the first printed land pattern for its family: (repeat, mm) of the callouts before the heading.

    The callouts stand between the last title before the heading and the heading; a title that names another family is
    another package's drawing.
    """
    headings = F.explode(occurrences(c(text), f"(?i){LAND_HEADING}", BEHIND, AHEAD)).alias("o")
    rows = docs.where(F.contains(F.upper(text), F.lit(LAND_HEADING))).select(key, F.upper(F.substring_index(F.trim(family), " ", 1)).alias("_f"), headings)
    rows = rows.select(key, "_f", "o.place", c("o.near").alias("_w")).withColumn("_w", F.when(F.contains(F.upper("_w"), F.lit(LAND_TITLE)), F.concat(F.lit(LAND_TITLE), F.expr(f"right(_w, length(substring_index(upper(_w), '{LAND_TITLE}', -1)))"))).otherwise(c("_w")))
    header = F.upper(F.regexp_extract("_w", rf"(?i)^{LAND_TITLE}\s*\n\s*\S+\s+([A-Z0-9-]+)", 1))
    named = F.when(c("_f").isNull(), True).when(header != "", header == c("_f")).otherwise(F.rlike(F.upper("_w"), F.concat(F.lit(r"\b"), c("_f"), F.lit(r"\b"))))
    pairs = F.arrays_zip(F.regexp_extract_all("_w", F.lit(CALLOUT), F.lit(1)).alias("n"), F.regexp_extract_all("_w", F.lit(CALLOUT), F.lit(2)).alias("v"))
    values = F.transform(pairs, lambda p: F.struct(p["n"].try_cast("int").alias("repeat"), p["v"].cast("double").alias("mm")))
    values = F.filter(values, lambda v: (v["mm"] > 0.1) & (v["mm"] <= 100))
    found = rows.where(named).withColumn("values", values).where(F.size("values") > 0)
    return found.groupBy(key).agg(F.min("place").cast("long").alias("place"), F.min_by("values", "place").alias("values"))


def unreadable_footprints(docs: DataFrame, key: str, text: str, family: str) -> DataFrame:
    """key, place: the first figure that shows the family's footprint in a form no reader knows; lines of a table of contents are no figures."""
    figures = F.explode(occurrences(c(text), r"(?i)\bfootprint example\b", CAPTION, AHEAD)).alias("o")
    rows = docs.select(key, F.upper(F.substring_index(F.trim(family), " ", 1)).alias("_f"), figures).select(key, "_f", "o.place", "o.near")
    after, caption = F.expr(f"substring(near, least(place, {CAPTION}) + 1)"), F.expr(f"left(near, least(place, {CAPTION}))")
    bare = lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")
    found = rows.where(~after.rlike(r"\.{4,}|(?:\.\s){4,}") & (c("_f").isNull() | F.contains(bare(caption), bare("_f"))))
    return found.groupBy(key).agg(F.min("place").cast("long").alias("place"))


def drawing_code(text: Column) -> Column:
    """struct code, prefix, leads: the code that a drawing is titled with, just after its heading, if its digits can be a lead count; else null."""
    title = F.regexp_extract(text, rf"(?is)((?:{DRAWING_HEADING}).{{0,{CODE_REACH}}})", 1)
    code = F.regexp_extract(title, r"\b([A-Z]{1,4}[0-9]{4}[A-Z])\b", 1)
    leads = F.regexp_extract(code, "([0-9]{4})", 1).try_cast("int")
    return F.when(leads.between(2, 2000), F.struct(code.alias("code"), F.regexp_extract(code, "^([A-Z]+)", 1).alias("prefix"), leads.alias("leads")))


def names_family(text: Column, family: Column) -> Column:
    """Does a text name a family: its letters and its digits may have a blank or a hyphen between them."""
    return F.rlike(F.upper(text), F.concat(F.lit(r"\b"), F.regexp_replace(F.upper(family), "^([A-Z]+)([0-9]+)$", r"$1[\\s-]?$2"), F.lit(r"\b")))


def ranked_drawings(pages: DataFrame, items: DataFrame, key: str, page: str, family: str) -> DataFrame:
    """key, page, rank, values, names_package: pages that are package drawings, best first, one and ALTERNATES more.

    A drawing has a heading and bare numbers all over; numbers in few columns are a table. items: key, page, x, str.
    """
    bare = items.where(F.trim("str").rlike(r"^\(?[0-9]{1,3}(?:\.[0-9]{1,3})?\)?$"))
    counts = bare.groupBy(key, page).agg(F.count(F.lit(1)).alias("values"), F.count_distinct(F.round(c("x") / COLUMN)).alias("_columns"))
    rows = pages.where(c("text").rlike(rf"(?i){DRAWING_HEADING}")).join(counts, [key, page])
    rows = rows.where((c("values") >= LEAST_VALUES) & (c("_columns") / c("values") >= LEAST_COLUMNS)).withColumn("names_package", F.coalesce(names_family(c("text"), c(family)), F.lit(False)))
    order = Window.partitionBy(key).orderBy(c("names_package").desc(), c("values").desc(), page)
    return rows.withColumn("rank", F.row_number().over(order)).where(c("rank") <= 1 + ALTERNATES).select(key, page, "rank", "values", "names_package")


def front_matter_end(pages: DataFrame, key: str) -> DataFrame:
    """key, front_end: where front matter ends: where the page after the third begins, or the text's end."""
    return pages.groupBy(key).agg(F.coalesce(F.min(F.when(c("page") == FRONT_PAGES + 1, c("start"))), F.max("end")).alias("front_end"))


def candidate_designators(variants: DataFrame, key: str, designator: str, in_front: str, place: str) -> DataFrame:
    """key, candidates: distinct designators, those in front matter first, at most eight; no row where there is no choice."""
    first = variants.groupBy(key, designator).agg(F.min(F.struct((~c(in_front)).alias("late"), c(place).alias("place"))).alias("_o"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_o", designator))
    rows = first.withColumn("_n", nth).where(c("_n") <= MOST_DESIGNATORS)
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", designator))).alias("_l"))
    return listed.where(F.size("_l") > 1).select(key, F.transform("_l", lambda x: x[designator]).alias("candidates"))


def pages_to_render(asked: Column, existing: Column) -> Column:
    """Pages a model asked for that exist, in order, each once, at most sixteen."""
    return F.slice(F.array_sort(F.array_intersect(asked, existing)), 1, MOST_PAGES)


def family_token(text: Column) -> Column:
    """The first package family a text names, in capitals, or null."""
    found = F.upper(F.regexp_extract(text, rf"(?i)\b({FAMILY})\b", 1))
    return F.when(found != "", found)
