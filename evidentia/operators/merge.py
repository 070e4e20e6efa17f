"""The whole way from a model's answers to a record whose every value says where it stands: one plan over both levels, the record's and its packages'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import written
from .evidence import stated_maximum
from .records import pad_row_taken_out, pin_table
from .text import quarantine

c = F.col
#: Fields that are pairs of ends, the field a drawing's title corrects, and from what difference on; shares of names a page must have.
RANGES = ["dimensions.leadWidthMm", "dimensions.leadSpanMm", "dimensions.leadSpanCrossMm", "dimensions.leadContactMm"]
HEIGHT, HEIGHT_OFF, NAMES_SHARE, MOST_HEIGHT = "dimensions.bodyHeightMm", 0.02, 0.6, 50.0
#: How a page states the overall height, the number it prints for itself, and that it is a pinout.
STATED_HEIGHT = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*mm\s+max\s+height"
PRINTED = r"(?i)\bpage\s+([0-9]{1,6})\s+of\s+[0-9]+"
PINOUT = r"(?i)\bpin\s*(?:connection|description|configuration|assignment|out|function)s?\b|\bterminal\s+(?:configuration|function)s?\b|\bpin\s+diagrams?\b"


PINS = "array<struct<number:string,name:string,kind:string>>"


def squeezed(text: Column) -> Column:
    """Lower case without white space: what quotes are compared in."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def number_text(x: Column) -> Column:
    """A number as a page would print it: no zeros behind the point, no point behind a whole number."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def evidence_pages(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """doc, page, hay (squeezed citable text), clean, printed (numbers its footers print), height (the one it states), pinout, letters.

    What is addressed to a reader of documents is cut out before anything is compared, and such a page isn't clean.
    Every rule of a merge looks at pages anew, so they are written once: texts are searched a single time, and a rule
    reads the columns it needs.
    """
    rows = quarantine(pages.select(F.struct(doc, page).alias("_at"), c(text).alias("_text")), "_at", "_text", keep=True)
    clean = c("regions") == 0
    printed = F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit(PRINTED), F.lit(1)), lambda x: x.cast("int")))
    found = rows.select(
        c(f"_at.{doc}").alias("doc"), c(f"_at.{page}").alias("page"), squeezed(c("citable")).alias("hay"), clean.alias("clean"), printed.alias("printed"),
        F.when(clean, stated_maximum(c("_text"), STATED_HEIGHT, MOST_HEIGHT)).alias("height"), (clean & c("_text").rlike(PINOUT)).alias("pinout"),
        F.regexp_replace(F.upper("_text"), "[^A-Z0-9]", "").alias("letters"),
    )
    return written(found, "evidence-pages")


def distinctive(pins: Column) -> Column:
    return F.filter(F.transform(pins, lambda p: p["name"]), lambda n: F.length(F.trim(n)) >= 2)


def quoted(hay: Column) -> Column:
    """Does a page's text show a claim: a pin table by most of its names, a pair by both ends, all else by what it says."""
    names = distinctive(c("pins"))
    there = F.filter(names, lambda n: F.contains(hay, squeezed(n)))
    needle = F.coalesce(number_text(c("number")), F.nullif(F.trim("words"), F.lit("")))
    return F.coalesce(
        F.when(c("pins").isNotNull(), (F.size(names) > 0) & (F.size(there) / F.size(names) >= NAMES_SHARE))
        .when(c("low").isNotNull(), F.contains(hay, number_text(c("low"))) & F.contains(hay, number_text(c("high"))))
        .otherwise(F.contains(hay, squeezed(needle))),
        F.lit(False),
    )


def gap_free(pins: Column) -> Column:
    numbers = F.transform(pins, lambda p: p["number"].try_cast("int"))
    return F.forall(numbers, lambda n: n.isNotNull() & (n >= 1)) & (F.size(F.array_distinct(numbers)) == F.size(numbers)) & (F.array_max(numbers) == F.size(numbers))


def sound(claims: DataFrame) -> DataFrame:
    """claims with their pins as numbered rows, `exposed` and `refused`: why a claim can't be trusted in its shape, or null."""
    is_range, is_pins = c("field").isin(RANGES), c("field") == "pins"
    table = pin_table(c("pins"))
    ends = c("low").isNotNull() & c("high").isNotNull() & (c("low") > 0) & (c("high") >= c("low"))
    rows = claims.withColumns({"_rows": table["pins"], "exposed": F.coalesce(table["exposed_pad"], F.lit(False)), "_why": table["refused"]})
    gaps = F.when(F.coalesce(gap_free(c("_rows")), F.lit(False)), F.lit(None)).otherwise("gaps")
    refused = F.when(is_range & ~F.coalesce(ends, F.lit(False)), "no range").when(is_pins, F.coalesce("_why", gaps))
    only = lambda when, name: F.when(when, c(name)).alias(name)  # noqa: E731  a claim has the one kind of value that its field has
    plain = ~is_range & ~is_pins
    return rows.select("doc", "package", "field", "page", only(plain, "number"), only(plain, "words"), only(is_range, "low"), only(is_range, "high"), F.when(is_pins, c("_rows")).alias("pins"), "exposed", refused.alias("refused"))


def placed(claims: DataFrame, pages: DataFrame, sent: DataFrame) -> DataFrame:
    """Sound claims with citation, method and confidence: the first rule that holds.

    The claimed page quotes it (0.5); the claimed page was shown as an image and nobody tampered with it (0.4); the same
    two for the one page whose footer prints the claimed number; for a pin table, the one shown pinout page, or of
    several the one that has over half of its names and more than any other. A package's table, which claims no page,
    is looked for on all pages of its document instead. pages: evidence_pages(); sent: doc, page.
    """
    shown = sent.select("doc", "page", F.lit(True).alias("sent")).distinct()
    known = pages.join(shown, ["doc", "page"], "left").withColumn("sent", F.coalesce("sent", F.lit(False)) & c("clean"))
    keyed = claims.withColumn("_id", F.struct("doc", "package", "field"))
    # the page that a footer's number means, where one page only prints it
    footers = pages.select("doc", "page", F.explode("printed").alias("number_")).groupBy("doc", "number_").agg(F.min("page").alias("real"), F.count(F.lit(1)).alias("n")).where("n = 1")
    rows = keyed.join(footers.select(c("doc").alias("_d"), "number_", "real"), (c("doc") == c("_d")) & (c("page") == c("number_")), "left").drop("_d")
    at = F.filter(F.array(F.struct(F.lit(0).alias("nth"), c("page").alias("at")), F.struct(F.lit(1).alias("nth"), F.when(c("real") != c("page"), c("real")).alias("at"))), lambda x: x["at"].isNotNull())
    looked = rows.where("not (field = 'pins' and package is not null)").select("*", F.explode(at).alias("x")).select("*", "x.nth", "x.at")
    looked = looked.join(known.select(c("doc").alias("_d"), c("page").alias("_p"), "hay", "sent"), (c("doc") == c("_d")) & (c("at") == c("_p")))
    rank = F.when(quoted(c("hay")), c("nth") * 2).when(c("sent"), c("nth") * 2 + 1)
    best = looked.select("_id", F.struct(rank.alias("rank"), c("at").alias("page")).alias("b")).where("b.rank is not null").groupBy("_id").agg(F.min("b").alias("b"))
    direct = best.select("_id", c("b.page").alias("citation"), F.when(c("b.rank") % 2 == 0, "vlm").otherwise("vlm-drawing").alias("method"))
    # a package's pin table, by its names on any page of the document
    tables = keyed.where("field = 'pins' and refused is null")
    anywhere = tables.where("package is not null").join(known.select(c("doc").alias("_d"), c("page").alias("_p"), "hay"), c("doc") == c("_d")).where(quoted(c("hay")))
    anywhere = anywhere.groupBy("_id").agg(F.min("_p").alias("citation")).withColumn("method", F.lit("vlm"))
    direct = direct.unionByName(anywhere)
    # what is left of the pin tables, by the pinout pages that were shown: their names decide between several
    rest = tables.join(direct, "_id", "left_anti").join(known.where("pinout and sent").select(c("doc").alias("_d"), c("page").alias("_p"), "letters"), c("doc") == c("_d"))
    wanted = F.filter(F.transform("pins", lambda p: F.regexp_replace(F.upper(p["name"]), "[^A-Z0-9]", "")), lambda n: F.length(n) >= 2)
    scores = rest.select("_id", F.size(wanted).alias("_n"), F.struct(F.size(F.filter(wanted, lambda n: F.contains("letters", n))).alias("score"), c("_p").alias("page")).alias("s"))
    scores = scores.groupBy("_id").agg(F.first("_n").alias("_n"), F.sort_array(F.collect_list("s"), False).alias("s"))  # pages that were shown: few
    one = F.size("s") == 1
    decisive = (c("s")[0]["score"] * 2 > c("_n")) & (c("s")[0]["score"] > F.try_element_at("s", F.lit(2))["score"])
    pinout = scores.where(one | decisive).select("_id", c("s")[0]["page"].alias("citation"), F.lit("vlm-drawing").alias("method"))
    found = keyed.join(direct.unionByName(pinout), "_id", "left").drop("_id")
    confidence = F.when(c("citation").isNotNull(), F.when(c("method") == "vlm-drawing", 0.4).otherwise(0.5))
    return found.withColumns({"confidence": confidence, "method": F.coalesce("method", F.lit("vlm"))})


def merged_answers(base: DataFrame, claims: DataFrame, pages: DataFrame, sent: DataFrame) -> DataFrame:
    """One row for each field of a record or of one of its packages: value, confidence, method, citation, and status.

    base: doc, field, and what it already says (number, words, low, high, pins), which no claim touches (status kept).
    claims: doc, package (null: the record's own), field, number, words, low, high, pins (array of number, name, kind),
    page. status: filled (a page shows it), uncited (kept, but nothing shows it), rejected (a shape that can't be
    trusted: no value; of packages such fields are left out), corrected is whether the drawing's title gave the height.
    A record whose pin table counts the pad under the part has the pad taken out, and exposed is true.
    """
    has = F.coalesce(c("number").isNotNull() | (F.trim("words") != "") | c("low").isNotNull() | c("high").isNotNull() | c("pins").isNotNull(), F.lit(False))
    answered = base.select(c("doc").alias("_d"), c("field").alias("_f"))
    open_ = claims.where(has).join(answered, (c("doc") == c("_d")) & (c("field") == c("_f")) & c("package").isNull(), "left_anti")
    open_ = open_.where(c("package").isNull() | (c("field") == "pins") | F.startswith("field", F.lit("dimensions.")))
    stated = pages.where("height is not null").select(c("doc").alias("_d"), c("page").alias("_p"), "height")
    rows = open_.join(stated, (c("doc") == c("_d")) & (c("page") == c("_p")), "left")
    off = F.coalesce(c("package").isNull() & (c("field") == HEIGHT) & (F.abs(c("height") - c("number")) >= HEIGHT_OFF), F.lit(False))
    rows = rows.withColumns({"corrected": off, "number": F.when(off, c("height")).otherwise(c("number"))}).drop("_d", "_p", "height")
    fixed = rows.where("corrected").select("doc", "field", "corrected")
    judged = placed(sound(rows), pages, sent)
    judged = judged.where(c("package").isNull() | c("refused").isNull())
    judged = judged.withColumn("pins", c("pins").cast(PINS)).join(fixed.select(c("doc").alias("_d"), c("field").alias("_f"), "corrected"), (c("doc") == c("_d")) & (c("field") == c("_f")) & c("package").isNull(), "left").drop("_d", "_f")
    bad = c("refused").isNotNull()
    blank = lambda n: F.when(~bad, c(n)).alias(n)
    status = F.when(bad, "rejected").when(c("citation").isNull(), "uncited").otherwise("filled")
    out = judged.select(
        "doc", "package", "field", *map(blank, ("number", "words", "low", "high", "pins", "confidence", "method", "citation")), (c("exposed") & ~bad).alias("exposed"),
        status.alias("status"), "refused", F.coalesce("corrected", F.lit(False)).alias("corrected"),
    )
    shape = lambda n, t: c(n).cast(t).alias(n)
    nothing = lambda n, t: F.lit(None).cast(t).alias(n)
    kept = base.select(
        "doc", nothing("package", "string"), "field", "number", "words", "low", "high", shape("pins", PINS), nothing("confidence", "double"), nothing("method", "string"),
        nothing("citation", out.schema["citation"].dataType), F.lit(False).alias("exposed"), F.lit("kept").alias("status"), nothing("refused", "string"), F.lit(False).alias("corrected"),
    )
    return pad_taken_out(out.unionByName(kept))


def pad_taken_out(rows: DataFrame) -> DataFrame:
    """rows where the last pin of a record is its pad, if its fields say so: the table has one row more than leads, and the pad's sizes are there."""
    record = Window.partitionBy("doc", "package")
    of = lambda field, value: F.max(F.when(c("field") == field, c(value))).over(record)
    own = c("package").isNull()
    leads, count, length, width = (of(f, "number") for f in ("dimensions.leadCount", "pinCount", "dimensions.thermalPadLengthMm", "dimensions.thermalPadWidthMm"))
    pins = F.max(F.when(c("field") == "pins", F.transform("pins", lambda p: p["number"]))).over(record)
    there = rows.withColumns({"_leads": leads, "_count": count, "_l": length, "_w": width, "_pins": pins, "_exposed": F.max("exposed").over(record)})
    out = pad_row_taken_out(c("_pins"), c("_leads").cast("int"), c("_count").cast("int"), c("_l"), c("_w"), c("_exposed"))
    there = there.withColumns({f"_new_{k}": v for k, v in out.items()})
    return there.withColumns({
        "pins": F.when(own & (c("field") == "pins") & c("pins").isNotNull(), F.slice("pins", F.lit(1), F.size("_new_pins"))).otherwise(c("pins")),
        "number": F.when(own & (c("field") == "pinCount"), c("_new_pin_count").cast("double")).otherwise(c("number")),
        "exposed": F.when(own & (c("field") == "pins"), c("_new_exposed_pad")).otherwise(c("exposed")),
    }).drop("_leads", "_count", "_l", "_w", "_pins", "_exposed", *(f"_new_{k}" for k in out))


def record_notes(rows: DataFrame) -> DataFrame:
    """doc, filled, uncited, rejected (fields in order, of the record itself), corrected, packages (names with anything usable): one row a document."""
    names = lambda when: F.array_sort(F.collect_list(F.when(when & c("package").isNull(), c("field"))))
    status = c("status")
    return rows.groupBy("doc").agg(
        names(status.isin("filled", "uncited")).alias("filled"), names(status == "uncited").alias("uncited"), names(status == "rejected").alias("rejected"),
        F.coalesce(F.max("corrected"), F.lit(False)).alias("corrected"), F.array_sort(F.collect_set("package")).alias("packages"),
    )
