"""Entity resolution that would rather not match than guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .identity import package_code
from .packages import FAMILY, outline_code, package_variants


#: Characters that may follow a drawing code's beginning; the length of the grams that containment is found by.
SEPARATORS, GRAM = (" ", "_", "-", "."), 3


def ends_of(rows: DataFrame, by: list[str], target: str) -> DataFrame:
    """by, lo, hi: the smallest and the largest target of each name. They are equal where a name has one target, however many rows say so."""
    return rows.groupBy(*by).agg(F.min(target).alias("lo"), F.max(target).alias("hi"))


def by_name(left: DataFrame, right: DataFrame, by: list[str], key: str, target: str) -> DataFrame:
    """key, lo, hi: what the rows of left, by equal names, name on the right. Targets are gathered by name first, so that no crowd of them is multiplied."""
    named = left.dropna(subset=by).select(key, *by).distinct().join(ends_of(right.dropna(subset=by), by, target), by)
    return named.groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def settled(tiers: list[DataFrame], key: str, target: str, vetoes: set[int] = frozenset()) -> DataFrame:
    """key, target, tier: the first tier (key, lo, hi) at which exactly one target matches.

    A tier with several targets decides nothing and is passed over; one in `vetoes` that has several ends the search.
    """
    found = None
    for t, hits in enumerate(tiers):
        hits = hits.select(key, F.lit(t).alias("tier"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias(target))
        found = hits if found is None else found.unionByName(hits)
    veto = F.min(F.when(F.col(target).isNull() & F.col("tier").isin(sorted(vetoes) or [-1]), F.col("tier")))
    best = F.min(F.when(F.col(target).isNotNull(), F.struct("tier", target)))
    out = found.groupBy(key).agg(best.alias("b"), veto.alias("v"))
    clear = F.col("b").isNotNull() & (F.col("v").isNull() | (F.col("v") > F.col("b.tier")))
    return out.where(clear).select(key, F.col(f"b.{target}").alias(target), F.col("b.tier").alias("tier"))


def ladder(left: DataFrame, right: DataFrame, key: str, target: str, tiers: list[tuple[Column, Column]], vetoes: set[int] = frozenset()) -> DataFrame:
    """key, target, tier: the first tier at which exactly one target matches, each tier a pair of match keys, null where it doesn't apply."""
    sides = [(left.select(key, a.alias("_m")), right.select(target, b.alias("_m"))) for a, b in tiers]
    return settled([by_name(a, b, ["_m"], key, target) for a, b in sides], key, target, vetoes)


def _inside(inner: DataFrame, outer: DataFrame, within: list[str]) -> DataFrame:
    """within, inner, outer: distinct names (column `name`) that stand in others.

    A name stands only in names that have all of its grams, so each is looked up by the one that the fewest have; what
    is found there is compared as a whole. Names shorter than a gram are looked up by all their letters.
    """
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - n + 1, F.lit(1))), lambda i: F.substring(F.col("name"), i, F.lit(n)))
    whole = lambda n: F.filter(grams(n), lambda g: F.length(g) == n)
    every = F.array_distinct(F.concat(*(whole(n) for n in range(1, GRAM + 1))))
    index = outer.select(*within, F.col("name").alias("outer"), F.explode(every).alias("gram"))
    size = F.least(F.length("name"), F.lit(GRAM))
    own = F.filter(every, lambda g: F.length(g) == F.least(F.length("name"), F.lit(GRAM)))
    asked = inner.where(size > 0).select(*within, F.col("name").alias("inner"), F.explode(own).alias("gram"))
    often = index.groupBy(*within, "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(often, [*within, "gram"], "left").groupBy(*within, "inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    rarest = rarest.where("r.n > 0").select(*within, "inner", F.col("r.gram").alias("gram"))
    return rarest.join(index, [*within, "gram"]).where(F.contains("outer", "inner")).select(*within, "inner", "outer")


def containing(left: DataFrame, right: DataFrame, within: list[str], key: str, target: str, name: str) -> DataFrame:
    """key, lo, hi: what the rows of left name on the right, where one of two names contains the other. Joined by grams, never by all pairs."""
    a, b = (df.dropna(subset=[*within, name]).where(F.length(name) > 0).withColumnRenamed(name, "name") for df in (left, right))
    x, y = a.select(*within, "name").distinct(), b.select(*within, "name").distinct()
    pairs = _inside(x, y, within).select(*within, F.col("inner").alias("name"), F.col("outer").alias("_of"))
    pairs = pairs.union(_inside(y, x, within).select(*within, F.col("outer").alias("name"), F.col("inner").alias("_of"))).distinct()
    ends = pairs.join(ends_of(b, [*within, "name"], target).withColumnRenamed("name", "_of"), [*within, "_of"])
    ends = ends.groupBy(*within, "name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return a.select(key, *within, "name").distinct().join(ends, [*within, "name"]).groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def code_heads(code: Column) -> Column:
    """A drawing code and what stands before each of its separators."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: F.when((i == F.length(code)) | F.substring(code, i + 1, F.lit(1)).isin(*SEPARATORS), F.substring(code, F.lit(1), i)))
    return F.array_compact(cuts)


def pin_tables_named(mentions: DataFrame, tables: DataFrame, doc: str, key: str, target: str) -> DataFrame:
    """key, target, tier: which table of pins of its document each designator names, if exactly one.

    mentions: doc, key, designator. tables: doc, target, names (array: what a document prints for the package), outline,
    pins (how many rows the table has; null without rows). The tiers: 0 a drawing code in square brackets at the end,
    which several tables may not share; 1 an equal name, by letters and digits; 2 a name within the other; 3 the same
    family and code in any order; 4 the lead count, if the designator declares one.
    """
    trimmed = F.trim("designator")
    code = outline_code(F.regexp_extract(trimmed, r"\[([^\]]+)\]\s*$", 1))
    bare = F.trim(F.regexp_replace(trimmed, r"\[[^\]]+\]\s*$", ""))
    fold = lambda x: F.nullif(F.regexp_replace(F.upper(x), "[^A-Z0-9]", ""), F.lit(""))
    family = lambda x: F.nullif(F.upper(F.regexp_extract(x, rf"(?i)\b(?:{FAMILY})\b", 0)), F.lit(""))
    asked = mentions.select(doc, key, code.alias("code"), bare.alias("label")).withColumn("name", fold("label"))
    names = tables.select(doc, target, F.explode("names").alias("label")).withColumn("name", fold("label"))
    outlines = tables.select(doc, target, outline_code(F.col("outline")).alias("code")).where("code is not null")
    coded = asked.where("code is not null")
    longer = by_name(coded.select(doc, key, F.explode(code_heads(F.col("code"))).alias("code")), outlines, [doc, "code"], key, target)
    shorter = by_name(coded, outlines.select(doc, target, F.explode(code_heads(F.col("code"))).alias("code")), [doc, "code"], key, target)
    drawings = longer.union(shorter).groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    said = lambda df: df.where("name is not null").withColumns({"family": family("label"), "code": package_code(F.col("label"))})
    leads = package_variants(asked, key, "label").where("leads is not null").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first("leads").alias("pins")).where("n = 1")
    counted = by_name(asked.join(leads, key), tables.select(doc, target, F.col("pins").cast("long").alias("pins")), [doc, "pins"], key, target)
    return settled(
        [drawings, by_name(asked, names, [doc, "name"], key, target), containing(asked, names, [doc], key, target, "name"), by_name(said(asked), said(names), [doc, "family", "code"], key, target), counted],
        key, target, {0},
    )


def fragments(name: Column) -> Column:
    """A label as the package names it lists, without the word package behind them."""
    spelt = F.translate(F.coalesce(name, F.lit("")), "_", " ")
    pieces = F.transform(F.split(spelt, r"[/;,]|\s+or\s+"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"(?i)\s+Packages?$", "")))
    return F.filter(pieces, lambda x: x != "")


def names_several(name: Column) -> Column:
    """Is a label about a set of packages: two or more of its fragments name a family or are a bare code."""
    named = F.filter(fragments(name), lambda x: x.rlike(rf"(?i)\b(?:{FAMILY})\b") | x.rlike("^[A-Z]{1,4}[0-9]{0,2}$"))
    return F.size(named) > 1


def drawing_name(first: Column, first_dims: Column, second: Column, second_dims: Column) -> Column:
    """The name of whichever of two joined entries carries measurements (maps of dimensions), the second's if both do; else null."""
    has = lambda dims: F.coalesce(F.size(dims), F.lit(0)) > 0
    return F.when(has(second_dims), second).when(has(first_dims), first)


def same_pin_names(left: Column, right: Column) -> Column:
    """Do two pin tables (arrays of number and name) give the same numbers the same names, in the same order; missing tables never do."""
    said = lambda pins: F.transform(pins, lambda p: F.concat(F.coalesce(p["number"], F.lit("")), F.lit("\x00"), F.coalesce(p["name"], F.lit(""))))
    return F.coalesce(said(left) == said(right), F.lit(False))


def partners(first: DataFrame, second: DataFrame, key: str, agree: list[str], contradict: list[str]) -> DataFrame:
    """key, a_entry, b_entry: the pairs of merge_entries in which neither entry has another partner. No pairs are listed.

    Entries with the same features have the same partners, so they are one class. Two classes fit if they have one value
    of `agree` in common and the same values of `contradict` where both have one. What must be equal depends on which
    values either lacks, so a class is filed under each set of values (a bit each) that the other side can have, and its
    partners' smallest and largest entries are read off there. They are equal where there is one partner.
    """
    features = list(dict.fromkeys([*agree, *contradict]))
    everything = (1 << len(contradict)) - 1
    ends = lambda lo, hi, nil: [F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.bool_or(nil).alias("nil")]

    def classes(rows: DataFrame) -> DataFrame:
        return rows.where(F.col(key).isNotNull()).groupBy(key, *features).agg(*ends("entry", "entry", F.col("entry").isNull()))

    def filed(rows: DataFrame, is_first: bool) -> DataFrame:
        """A row for each feature to agree on and each set of values the other side can have: _x, its value _v, both sets, what must be equal."""
        own = sum((F.col(x).isNotNull().cast("int") * (1 << i) for i, x in enumerate(contradict)), F.lit(0))
        named = F.array(*(F.struct(F.lit(i).alias("_x"), F.col(x).cast("string").alias("_v")) for i, x in enumerate(agree)))
        rows = rows.withColumn("_own", own).withColumn("_n", F.explode(F.filter(named, lambda n: n["_v"].isNotNull())))
        rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(everything))))
        same = [F.when(F.col("_other").bitwiseAND(F.lit(1 << i)) != 0, F.col(x)).alias(f"_s{i}") for i, x in enumerate(contradict)]
        pair = ("_own", "_other") if is_first else ("_other", "_own")
        return rows.select(key, "_n._x", "_n._v", F.col(pair[0]).alias("_pa"), F.col(pair[1]).alias("_pb"), *same, *features, "lo", "hi", "nil")

    at = [key, "_x", "_v", "_pa", "_pb"]
    equal = [f"_s{i}" for i in range(len(contradict))]

    def known(asked: DataFrame, others: DataFrame, entry: str, other: str, rows: DataFrame) -> DataFrame:
        """key, entry, other: entries that have one partner in all."""
        found = others.groupBy(*at, *equal).agg(*ends("lo", "hi", F.col("nil")))
        found = found.select(*(F.col(x).alias(f"r{x}") for x in [*at, *equal]), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("nil").alias("_nil"))
        # nothing is broadcast: a table that Spark guesses small may have millions of entries
        on = [F.col(x) == F.col(f"r{x}") for x in at] + [F.col(x).eqNullSafe(F.col(f"r{x}")) for x in equal]
        of_class = asked.join(found.hint("merge"), on).groupBy(key, *features).agg(*ends("_lo", "_hi", F.col("_nil")))
        of_class = of_class.select(*(F.col(x).alias(f"r{x}") for x in [key, *features]), "lo", "hi", "nil")
        on = [F.col(key) == F.col(f"r{key}")] + [F.col(x).eqNullSafe(F.col(f"r{x}")) for x in features]
        of_entry = rows.select(key, "entry", *features).hint("merge").join(of_class, on).groupBy(key, "entry").agg(*ends("lo", "hi", F.col("nil")))
        one = F.col("lo").eqNullSafe(F.col("hi")) & ~(F.col("nil") & F.col("lo").isNotNull())
        return of_entry.where(one).select(F.col(key).alias(f"_{entry}_key"), F.col("entry").alias(entry), F.col("lo").alias(other))

    a, b = filed(classes(first), True), filed(classes(second), False)
    a_sole, b_sole = known(a, b, "a_entry", "_b", first), known(b, a, "b_entry", "_a", second)
    mutual = (F.col("_a_entry_key") == F.col("_b_entry_key")) & F.col("a_entry").eqNullSafe(F.col("_a")) & F.col("b_entry").eqNullSafe(F.col("_b"))
    return a_sole.join(b_sole.hint("merge"), mutual).select(F.col("_a_entry_key").alias(key), "a_entry", "b_entry")


def merge_entries(first: DataFrame, second: DataFrame, key: str, agree: list[str], contradict: list[str], values: list[str]) -> DataFrame:
    """Entries of two passes as one list: a pair is one entity if they agree on a feature, contradict none, and neither has another partner.

    Values of the first pass stand, gaps are filled from the second; entries without partner stay by themselves.
    key: what entries are grouped by (a document); entries carry `entry` ids.
    """
    sole = partners(first, second, key, agree, contradict)
    left = first.hint("merge").join(sole.select(key, F.col("a_entry").alias("entry"), "b_entry"), [key, "entry"], "left")
    right = second.select(F.col(key).alias("_k"), F.col("entry").alias("_e"), *(F.col(v).alias(f"_{v}") for v in values))
    left = left.join(right.hint("merge"), (F.col(key) == F.col("_k")) & (F.col("b_entry") == F.col("_e")), "left")
    joined = left.select(key, "entry", F.col("b_entry").alias("merged"), *(F.coalesce(v, f"_{v}").alias(v) for v in values))
    alone = second.hint("merge").join(sole.select(key, F.col("b_entry").alias("entry")), [key, "entry"], "left_anti")
    return joined.unionByName(alone.select(key, "entry", F.lit(None).cast(joined.schema["merged"].dataType).alias("merged"), *values))


def caption_broadcast(captions: DataFrame, entries: DataFrame, key: str, caption: str, leads: str, code: str) -> DataFrame:
    """key, caption_id, entry: a caption that names several packages goes to each entry it names and whose leads agree, where one entry only fits a name."""
    names = captions.select(key, "caption_id", leads, F.explode(F.filter(F.transform(F.split(caption, "[/;,]| or "), lambda s: F.upper(F.trim(s))), lambda s: s != "")).alias("_name")).distinct()
    hits = names.join(entries.select(key, "entry", F.col(leads).alias("_l"), F.upper(code).alias("_name")), [key, "_name"]).where(F.col(leads) == F.col("_l"))
    one = hits.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "caption_id", "_name"))).where("_n = 1")
    return one.select(key, "caption_id", "entry").distinct()
