"""Records whose fields carry where they come from: access by path, overlays, projections, edits, settings and display.

A field is either a plain column or a struct (value, confidence, method, citation). Everything here is a projection of
one row; only what a record takes from a child table is a join, on the record's key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bounds of settings in mm, densities, sources of a footprint, and the settings that no standard answers.
MAX_SPAN, MAX_CONTACT = 200.0, 5.0
DENSITIES, SOURCES = ["A", "B", "C"], ["datasheet-first", "standard-always"]
REQUIRED = ["formedLeadSpanMm", "formedLeadContactMm"]
EXTRACTED = "struct<value:{0},confidence:double,method:string,citation:int>"


def at(df: DataFrame, path: str) -> Column:
    """The field at a dotted path. An unknown path is an error, here and not when the job runs."""
    kind = df.schema
    for name in path.split("."):
        if not isinstance(kind, StructType) or name not in kind.names:
            raise KeyError(path)
        kind = kind[name].dataType
    return F.col(".".join(f"`{n}`" for n in path.split(".")))


def put(df: DataFrame, path: str, value: Column) -> DataFrame:
    """df with the field at a dotted path replaced; the fields beside it stay."""
    at(df, path)
    head, _, rest = path.partition(".")
    return df.withColumn(head, F.col(f"`{head}`").withField(rest, value) if rest else value)


def peek(entries: Column, name: str) -> Column:
    """A named value of a map, null where there is none."""
    return F.try_element_at(entries, F.lit(name))


def blank(parts: DataFrame, key: str, fields: dict[str, str], seeds: dict[str, Column]) -> DataFrame:
    """A record for each part: every field unknown, but for seeds that are certain from the start."""
    unknown = lambda kind: F.lit(None).cast(EXTRACTED.format(kind))
    known = lambda v, kind: F.struct(v.cast(kind).alias("value"), F.lit(1.0).alias("confidence"), F.lit("deterministic").alias("method"), F.lit(None).cast("int").alias("citation"))
    return parts.select(key, *((known(seeds[n], kind) if n in seeds else unknown(kind)).alias(n) for n, kind in fields.items()))


def stripped(records: DataFrame, key: str, fields: list[str], identity: list[str]) -> DataFrame:
    """The bare values of fields; those that identify a part read Unknown where they are unknown."""
    value = lambda n: F.coalesce(F.col(f"{n}.value").cast("string"), F.lit("Unknown")) if n in identity else F.col(f"{n}.value")
    return records.select(key, *(value(n).alias(n) for n in fields))


def overlaid(records: DataFrame, filled: list[str], corrected: list[str], prefix: str = "given_") -> DataFrame:
    """What people supplied (columns with the prefix) laid over what was read: it fills blanks, but of corrected fields it wins."""
    given = lambda n: F.col(prefix + n)
    return records.withColumns({n: F.coalesce(n, given(n)) for n in filled} | {n: F.coalesce(given(n), F.col(n)) for n in corrected})


def cited_only(rows: DataFrame, value: str = "value", citation: str = "citation") -> DataFrame:
    """Rows that have a value and a page to show for it."""
    return rows.where(F.col(value).isNotNull() & F.col(citation).isNotNull())


def rekeyed(records: DataFrame, of_packages: DataFrame, key: str, package: str, field: str, fields: list[str]) -> DataFrame:
    """key, package, fields: for each package of a record only what the document says of that package, with a citation; all else unknown."""
    cited = cited_only(of_packages)
    wide = cited.groupBy(key, package).agg(*(F.max(F.when(F.col(field) == n, F.col("value"))).alias(n) for n in fields))
    every = of_packages.select(key, package).distinct()
    return records.select(key).join(every, key).join(wide, [key, package], "left").select(key, package, *fields)


def grafted(records: DataFrame, tables: DataFrame, key: str, sole_blocker: Column | None = None) -> DataFrame:
    """records with pins, pin_count and exposed_pad of the table located for them, at confidence .5 if it is cited.

    sole_blocker: graft only where this holds (the pin table is all that keeps a record from being exported).
    """
    t = tables.select(key, *(F.col(c).alias(f"_{c}") for c in ("pins", "exposed_pad", "citation")))
    rows = records.join(t, key, "left")
    take = F.col("_pins").isNotNull() & (F.lit(True) if sole_blocker is None else F.coalesce(sole_blocker, F.lit(False)))
    out = rows.withColumns({
        "pins": F.when(take, F.col("_pins")).otherwise(F.col("pins")), "pin_count": F.when(take, F.size("_pins")).otherwise(F.col("pin_count")),
        "exposed_pad": F.when(take, F.col("_exposed_pad")).otherwise(F.lit(False)), "confidence": F.when(take & F.col("_citation").isNotNull(), F.lit(0.5)),
        "grafted": take,
    })
    return out.drop("_pins", "_exposed_pad", "_citation")


def pins_edited(pins: Column, number: Column, name: Column) -> Column:
    """array of (number, name, method, citation) with one name overwritten: the user's, its citation kept."""
    mine = lambda p: F.struct(p["number"].alias("number"), name.alias("name"), F.lit("user").alias("method"), p["citation"].alias("citation"))
    return F.transform(pins, lambda p: F.when(p["number"] == number, mine(p)).otherwise(p))


def confirmed(rows: DataFrame, confirmations: DataFrame, keys: list[str]) -> DataFrame:
    """rows with confidence 1 and method user-confirmed where a person confirmed a value; citations stay."""
    marks = confirmations.select(*keys, F.lit(True).alias("_yes")).distinct()
    out = rows.join(marks, keys, "left")
    yes = F.col("_yes") & F.col("value").isNotNull()
    return out.withColumns({"confidence": F.when(yes, 1.0).otherwise(F.col("confidence")), "method": F.when(yes, "user-confirmed").otherwise(F.col("method"))}).drop("_yes")


def settings(raw: Column) -> dict[str, Column]:
    """Settings in a JSON text, of its outermost object only: densities and sources that exist, numbers (not texts) within bounds; all else is dropped."""
    tree = F.try_parse_json(raw)
    member = lambda n: F.try_variant_get(tree, f"$.{n}", "variant")
    kind = lambda n: F.schema_of_variant(member(n))
    word = lambda n: F.when(kind(n) == "STRING", F.try_variant_get(tree, f"$.{n}", "string"))
    number = lambda n: F.when(kind(n).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(tree, f"$.{n}", "double"))
    density, source = word("densityLevel"), word("footprintSource")
    span, contact = number("formedLeadSpanMm"), number("formedLeadContactMm")
    return {
        "density": F.when(density.isin(DENSITIES), density),
        "source": F.when(source.isin(SOURCES), source),
        "formedLeadSpanMm": F.when((span > 0) & (span <= MAX_SPAN), span),
        "formedLeadContactMm": F.when((contact > 0) & (contact <= MAX_CONTACT), contact),
    }


def settings_resolved(rows: DataFrame, raw: str) -> DataFrame:
    """rows with their settings, what blank ones stand for, which required ones are missing, and whether none is."""
    found = rows.withColumns(settings(F.col(raw)))
    missing = F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in REQUIRED)))
    defaults = {"density": F.coalesce("density", F.lit("B")), "source": F.coalesce("source", F.lit("datasheet-first"))}
    return found.withColumns(defaults | {"missing": missing}).withColumn("complete", F.size("missing") == 0)


def number_shown(value: Column, unit: str) -> Column:
    return F.when(value.isNull(), "not read").otherwise(F.concat_ws(" ", value.cast("string"), F.lit(unit)))


def range_shown(low: Column, high: Column) -> Column:
    one = F.concat_ws(" ", low.cast("string"), F.lit("mm"))
    two = F.concat_ws(" ", low.cast("string"), F.lit("to"), high.cast("string"), F.lit("mm"))
    return F.when(low.isNull() | high.isNull(), "not read").when(low == high, one).otherwise(two)


def pins_shown(pins: Column, most: int = 4) -> Column:
    """How many pins, and the first few as number=name; pins: array of (number, name)."""
    head = F.array_join(F.transform(F.slice(pins, 1, most), lambda p: F.concat_ws("=", p["number"], p["name"])), ", ")
    text = F.concat(F.size(pins).cast("string"), F.lit(" pins: "), head, F.when(F.size(pins) > most, ", ...").otherwise(""))
    return F.when(pins.isNull(), "not read").otherwise(text)


def readout(records: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """One response for each record: left joins of what was worked out beside it, each with a row for each record at most."""
    return reduce(lambda left, right: left.join(right, key, "left"), parts, records)


def pin_table(rows: Column) -> dict[str, Column]:
    """pins (number, name, kind of numbered rows), exposed_pad and refused (why the table can't be used) of an array of (number, name, kind).

    A designator that is no number is the pad under the part; with none but letters and digits of a grid it is an array
    of balls, which has no leads. A table without numbers, or with a nameless pin, is refused.
    """
    clean = F.transform(rows, lambda r: F.struct(F.trim(r["number"]).alias("number"), F.trim(r["name"]).alias("name"), r["kind"].alias("kind")))
    numbered = F.filter(clean, lambda r: r["number"].rlike("^[0-9]+$"))
    others = F.filter(clean, lambda r: ~r["number"].rlike("^[0-9]+$"))
    grid = (F.size(others) > 0) & F.forall(others, lambda r: r["number"].rlike("^[A-Za-z]{1,2}[0-9]{1,3}$"))
    kinds = ["input", "output", "power"]
    typed = F.transform(numbered, lambda r: F.struct(r["number"].alias("number"), r["name"].alias("name"), F.when(r["kind"].isin(kinds), r["kind"]).otherwise("unspecified").alias("kind")))
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    refused = (
        F.when(rows.isNull() | (F.size(rows) == 0), "empty")
        .when(F.exists(clean, lambda r: empty(r["number"])), "no number")
        .when(F.exists(numbered, lambda r: empty(r["name"])), "no name")
        .when((F.size(numbered) == 0) & grid, "grid array")
        .when(F.size(numbered) == 0, "no numbered rows")
    )
    return {"pins": F.when(refused.isNull(), typed), "exposed_pad": F.when(refused.isNull(), F.size(others) > 0), "refused": refused}


def pad_row_taken_out(pins: Column, leads: Column, pin_count: Column, pad_length: Column, pad_width: Column, exposed: Column) -> dict[str, Column]:
    """pins, pin_count, exposed_pad: the last of leads + 1 rows is the pad under the part, if its sizes are known and its number is the count."""
    n = F.size(pins)
    last = F.try_element_at(pins, F.lit(-1)).try_cast("int")
    hit = F.coalesce(~exposed & (n == leads + 1) & pad_length.isNotNull() & pad_width.isNotNull() & (last == n), F.lit(False))
    return {
        "exposed_pad": exposed | hit,
        "pins": F.when(hit, F.slice(pins, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(pins),
        "pin_count": F.when(hit & (pin_count == n), leads).otherwise(pin_count),
    }


def passes_combined(first: DataFrame, second: DataFrame, keys: list[str], field: str, pins: str) -> DataFrame:
    """keys, field, value, page: the second pass wins, except for pins that it reads on another page and in another way."""
    a = first.select(*keys, field, F.col("value").alias("_v1"), F.col("page").alias("_p1"))
    b = second.select(*keys, field, F.col("value").alias("_v2"), F.col("page").alias("_p2"))
    rows = a.join(b, [*keys, field], "full_outer")
    conflict = (F.col(field) == pins) & F.col("_v1").isNotNull() & F.col("_v2").isNotNull() & ~F.col("_p1").eqNullSafe(F.col("_p2")) & (F.col("_v1") != F.col("_v2"))
    first_stands = conflict | F.col("_v2").isNull()
    return rows.select(*keys, field, F.when(first_stands, F.col("_v1")).otherwise(F.col("_v2")).alias("value"), F.when(first_stands, F.col("_p1")).otherwise(F.col("_p2")).alias("page"))


def dims_named(dims: Column, names: dict[str, str]) -> Column:
    """A map of dimensions under their full names: short names are spelled out, unknown ones go."""
    full = F.create_map(*(F.lit(x) for short, name in names.items() for x in (short, name)), *(F.lit(x) for name in dict.fromkeys(names.values()) if name not in names for x in (name, name)))
    named = F.transform(F.map_entries(dims), lambda e: F.struct(F.try_element_at(full, e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.filter(named, lambda e: e["key"].isNotNull()))


def options_named(tables: DataFrame, key: str, package: str, outline: str) -> DataFrame:
    """tables with `option`: the package's name, and its outline in brackets where two tables of a record would read alike."""
    from pyspark.sql import Window

    from ..functions.text import alnum_fold

    alike = F.count(F.lit(1)).over(Window.partitionBy(key, alnum_fold(F.col(package))))
    marked = F.concat(F.col(package), F.lit(" ["), F.col(outline), F.lit("]"))
    return tables.withColumn("option", F.when((alike > 1) & F.col(outline).isNotNull(), marked).otherwise(F.col(package)))
