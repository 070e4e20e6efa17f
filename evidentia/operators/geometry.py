"""Pad arrays, their invariants, and the eight checks of a part's record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

c = F.col
TOUCHING = 1e-6


def record_checks() -> dict[str, Column]:
    """id -> pass, fail or unavailable, over the columns of a part record (see plans.geometry). Unknown stays unknown."""

    def state(available: Column, good: Column) -> Column:
        return F.when(F.coalesce(available, F.lit(False)), F.when(good, "pass").otherwise("fail")).otherwise("unavailable")

    has = lambda *names: _all([c(n).isNotNull() for n in names])
    across = F.least("body_width", "body_length")
    counts = F.transform(F.split("sides", ","), lambda s: F.trim(s).try_cast("int"))
    total = F.aggregate(counts, F.lit(0), lambda a, n: a + F.coalesce(n, F.lit(-1_000_000)))
    numbers = F.filter(F.transform("pins", lambda p: p.try_cast("int")), lambda n: n.isNotNull())
    span, contact, width = ((c(f"{n}_min"), c(f"{n}_max")) for n in ("span", "contact", "lead_width"))
    most, least = (G.land_pattern(span, contact, width, level) for level in "AC")
    reach = c("land_span") + c("land_length")
    return {
        "pins-match-count": F.when(F.size(numbers) == c("pin_count"), "pass").otherwise("fail"),
        "pin-numbers-complete": state(F.size(numbers) > 0, (F.size(F.array_distinct(numbers)) == F.size(numbers)) & (F.array_max(numbers) == F.size(numbers)) & (F.array_min(numbers) >= 1)),
        "sides-add-up": state(has("sides"), F.forall(counts, lambda n: n.isNotNull() & (n >= 0)) & (total == c("pin_count"))),
        "lands-clear-centre": state(has("land_length", "land_span"), (c("land_span") - c("land_length") > 0) & F.coalesce(c("land_span_cross") - c("land_length") > 0, F.lit(True))),
        "lands-fit-pitch": state(has("land_width", "pitch"), c("land_width") < c("pitch")),
        "span-covers-body": state(has("span_min", "span_max") & across.isNotNull(), c("span_max") >= across),
        "thermal-pad-fits": state(has("thermal_length", "thermal_width", "body_length", "body_width"), (c("thermal_length") < c("body_length")) & (c("thermal_width") < c("body_width"))),
        "printed-in-band": state(
            has("land_length", "land_span", "span_min", "lead_width_min", "contact_min") & (c("lead_form") == "gullwing") & most.isNotNull() & least.isNotNull(),
            (reach >= least["z"]) & (reach <= most["z"]),
        ),
    }


def _all(columns: list[Column]) -> Column:
    out = columns[0]
    for x in columns[1:]:
        out = out & x
    return out


def checks_long(records: DataFrame, key: str) -> DataFrame:
    """key, check_id, state: one row for each check of each record, made within the row."""
    checks = record_checks()
    wide = records.select(key, *(expr.alias(f"k{i}") for i, expr in enumerate(checks.values())))
    pairs = F.array(*(F.struct(F.lit(name).alias("check_id"), c(f"k{i}").alias("state")) for i, name in enumerate(checks)))
    return wide.select(key, F.explode(pairs).alias("p")).select(key, "p.check_id", "p.state")


def pads(parts: DataFrame, key: str, arrangement: str) -> DataFrame:
    """key, number, x, y, w, h of each pad. parts: n, pitch, centre, pad_length, pad_width (and, for quad, cross); y points down.

    dual: left column from top to bottom, right one upwards from the bottom. quad: left down, bottom to the right, right
    up, top to the left; sides take the pins in turn, the first ones one more. single: a row along x.

    Parts are dealt out by their key before they become many rows: a table of a few MB would else be multiplied in one
    task, and what gathers or joins lands by part finds them together.
    """
    n, p, k = c("n"), c("pitch"), c("__nth")
    rows = parts.repartition(key).select("*", F.explode(F.sequence(F.lit(1), n)).alias("number")).withColumn("__nth", c("number") - 1)
    if arrangement == "single":
        return rows.select(key, "number", ((k - (n - 1) / 2) * p).alias("x"), F.lit(0.0).alias("y"), c("pad_width").alias("w"), c("pad_length").alias("h"))
    if arrangement == "dual":
        side = F.ceil(n / 2).cast("int")
        left = k < side
        row = F.when(left, k).otherwise(n - 1 - k)  # the right column is numbered from its bottom
        x = F.when(left, -c("centre")).otherwise(c("centre"))
        return rows.select(key, "number", x.alias("x"), (-(side - 1) * p / 2 + row * p).alias("y"), c("pad_length").alias("w"), c("pad_width").alias("h"))
    if arrangement != "quad":
        raise ValueError(arrangement)
    # columns of their own, each looked at many times; written out they would be code too long to be compiled
    rows = rows.withColumns({"__base": F.floor(n / 4).cast("int"), "__more": n % 4})
    base, more = c("__base"), c("__more")
    first = lambda s: base * s + F.least(more, F.lit(s))
    rows = rows.withColumn("__side", sum(((k >= first(s)).cast("int") for s in (2, 3)), (k >= first(1)).cast("int")))
    side = c("__side")
    begin, count = base * side + F.least(more, side), base + (more > side).cast("int")
    rows = rows.withColumn("__along", (k - begin - (count - 1) / 2) * p)
    along, cross = c("__along"), F.coalesce("cross", "centre")
    x = F.when(side == 0, -c("centre")).when(side == 1, along).when(side == 2, c("centre")).otherwise(-along)
    y = F.when(side == 0, along).when(side == 1, cross).when(side == 2, -along).otherwise(-cross)
    upright = side % 2 == 1
    w = F.when(upright, c("pad_width")).otherwise(c("pad_length"))
    h = F.when(upright, c("pad_length")).otherwise(c("pad_width"))
    return rows.select(key, "number", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def overlapping(pads_: DataFrame, key: str) -> DataFrame:
    """key, a, b: pairs of pads of one part, a before b, that overlap. An equi-join on the part with the rest as its condition.

    Pads are many times what their parts are, by which Spark guesses their size: they are never broadcast.
    """
    a = pads_.select(key, *(c(x).alias(f"a_{x}") for x in ("number", "x", "y", "w", "h")))
    b = pads_.select(key, *(c(x).alias(f"b_{x}") for x in ("number", "x", "y", "w", "h")))
    hit = G.overlaps({x: c(f"a_{x}") for x in "xywh"}, {x: c(f"b_{x}") for x in "xywh"}, TOUCHING)
    pairs = a.join(b.hint("merge"), key).where((c("a_number") < c("b_number")) & F.coalesce(hit, F.lit(False)))
    return pairs.select(key, c("a_number").alias("a"), c("b_number").alias("b"))


def nearest_pad(pads_: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """key, nearest, distance: the pad whose centre is nearest to the part's marker (mx, my), the lowest number of equals."""
    d = F.sqrt((c("x") - c("mx")) * (c("x") - c("mx")) + (c("y") - c("my")) * (c("y") - c("my")))
    rows = pads_.join(markers.hint("merge"), key).withColumn("_d", d)
    return rows.groupBy(key).agg(F.min_by("number", F.struct("_d", "number")).alias("nearest"), F.min("_d").alias("distance"))


def violations(parts: DataFrame, pads_: DataFrame, key: str) -> DataFrame:
    """key, kind, n: how often a footprint breaks each invariant; kinds that it keeps have no row.

    parts: n (pins), half_width, half_height (courtyard), mx, my (pin-1 marker), and, where they are there, exposed (a
    land more) and pins (numbers in the pin table). pads_: number, x, y, w, h, and, where they are there, drill, plated
    and paste (array of x, y, w, h). A part's lands are put into one row once, bounded by its pins, and judged there.
    """
    has = lambda df, n, empty: c(n) if n in df.columns else F.lit(None).cast(empty)
    box = "array<struct<x:double,y:double,w:double,h:double>>"
    land = F.struct("number", "x", "y", "w", "h", has(pads_, "drill", "double").alias("drill"), F.coalesce(has(pads_, "plated", "boolean"), F.lit(False)).alias("plated"), F.coalesce(has(pads_, "paste", box), F.array().cast(box)).alias("paste"))
    lands = pads_.groupBy(key).agg(F.array_sort(F.collect_list(land)).alias("_p"))
    columns = [c(n) for n in ("n", "half_width", "half_height", "mx", "my")]
    exposed, table = F.coalesce(has(parts, "exposed", "boolean"), F.lit(False)).alias("_e"), F.coalesce(has(parts, "pins", "array<string>"), F.array().cast("array<string>")).alias("_t")
    rows = parts.select(key, *columns, exposed, table).join(lands.hint("merge"), key, "left").withColumn("_p", F.coalesce("_p", F.array()))
    p, count = c("_p"), lambda test: F.size(F.filter("_p", test))
    wanted = F.sequence(F.lit(1), c("n") + c("_e").cast("int"))
    numbers = F.transform(p, lambda a: a["number"].cast("int"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    distance = lambda a: F.sqrt((a["x"] - c("mx")) * (a["x"] - c("mx")) + (a["y"] - c("my")) * (a["y"] - c("my")))
    rest = lambda i: F.slice(p, i + 2, F.greatest(F.size(p), F.lit(1)))
    pairs = F.aggregate(F.transform(p, lambda a, i: F.size(F.filter(rest(i), lambda b: G.overlaps({x: a[x] for x in "xywh"}, {x: b[x] for x in "xywh"}, TOUCHING)))), F.lit(0), lambda s, n: s + n)
    past = lambda a: F.size(F.filter(a["paste"], lambda q: (F.abs(q["x"] - a["x"]) + q["w"] / 2 > a["w"] / 2 + TOUCHING) | (F.abs(q["y"] - a["y"]) + q["h"] / 2 > a["h"] / 2 + TOUCHING)))
    one = F.array_min(F.transform(F.filter(p, lambda a: a["number"] == 1), distance))
    other = F.array_min(F.transform(F.filter(p, lambda a: a["number"] != 1), distance))
    kinds = {
        "land-count": F.size(F.filter(wanted, lambda i: F.size(F.filter(numbers, lambda k: k == i)) != 1)),
        "stray-land": F.size(F.array_except(numbers, wanted)),
        "unplaced-pin": F.size(F.filter("_t", lambda x: x.rlike("^[0-9]+$") & ~F.array_contains(numbers, x.try_cast("int")))),
        "overlap": pairs,
        "courtyard": count(lambda a: (F.abs(a["x"]) + a["w"] / 2 > c("half_width") + TOUCHING) | (F.abs(a["y"]) + a["h"] / 2 > c("half_height") + TOUCHING)),
        "paste-on-hole": count(lambda a: a["plated"] & (F.size(a["paste"]) > 0)),
        "paste-past-copper": F.aggregate(F.transform(p, past), F.lit(0), lambda s, n: s + n),
        "no-pin-1": one.isNull().cast("int"),
        "marker": F.coalesce(one > other + TOUCHING, F.lit(False)).cast("int"),
        "non-finite": count(lambda a: ~(finite(a["x"]) & finite(a["y"]) & finite(a["w"]) & finite(a["h"]))),
        "no-drill": count(lambda a: a["plated"] & ~F.coalesce(a["drill"] > 0, F.lit(False))),
    }
    listed = F.array(*(F.struct(F.lit(k).alias("kind"), e.cast("long").alias("n")) for k, e in kinds.items()))
    return rows.select(key, F.explode(listed).alias("_v")).select(key, "_v.kind", "_v.n").where("n > 0")


def paste_grid(parts: DataFrame, key: str, length: str, width: str) -> DataFrame:
    """key, ix, iy, x, y, w, h: paste apertures of a thermal land, in even cells, at the coverage the standard asks for."""
    nx, ny = G.paste_cells(c(length)), G.paste_cells(c(width))
    w, h = c(length) * (G.COVERAGE**0.5) / c("nx"), c(width) * (G.COVERAGE**0.5) / c("ny")
    rows = parts.where((c(length) > 0) & (c(width) > 0)).withColumn("nx", nx).withColumn("ny", ny)
    rows = rows.withColumn("_w", w).withColumn("_h", h).where((c("_w") >= G.APERTURE_MIN) & (c("_h") >= G.APERTURE_MIN))
    rows = rows.withColumn("ix", F.explode(F.sequence(F.lit(0), c("nx") - 1))).withColumn("iy", F.explode(F.sequence(F.lit(0), c("ny") - 1)))
    x = (c("ix") - (c("nx") - 1) / 2) * (c(length) / c("nx"))
    y = (c("iy") - (c("ny") - 1) / 2) * (c(width) / c("ny"))
    return rows.select(key, "ix", "iy", x.alias("x"), y.alias("y"), c("_w").alias("w"), c("_h").alias("h"))


def footprint_text(parts: DataFrame, pads_: DataFrame, key: str, name: str) -> DataFrame:
    """key, body: a footprint as an s-expression, its pads in order of their numbers. One aggregation by part; texts are many times what Spark guesses them to be, and never broadcast."""
    line = F.format_string('  (pad "%d" smd rect (at %.3f %.3f) (size %.3f %.3f) (layers "F.Cu" "F.Paste" "F.Mask"))', "number", "x", "y", "w", "h")
    listed = pads_.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("number", line.alias("line"))))["line"], "\n").alias("_l"))
    head = F.concat(F.lit('(footprint "'), F.regexp_replace(name, r'(["\\])', r"\\$1"), F.lit('"\n  (layer "F.Cu")\n'))
    return parts.join(listed.hint("merge"), key).select(key, F.concat(head, "_l", F.lit("\n)")).alias("body"))
