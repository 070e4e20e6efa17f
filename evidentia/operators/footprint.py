"""From a record to a footprint: the printed land, the computed one, or what has to be asked; pad rows, units and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

c = F.col
#: Fixed values in mm: a lead's largest part of the pitch, tolerance of the band, agreement of lands, chamfer of a body's outline and its largest part.
WIDEST_LEAD, BAND, AGREEMENT, CHAMFER, CHAMFER_PART = 0.75, 0.01, 0.12, 1.0, 0.25
#: Altium's units in a mil, and the range of its coordinates.
UNITS_A_MIL, INT32 = 10_000, 2**31


def _positive(x: Column) -> Column:
    return F.coalesce((x > 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False))


def drawn_lead(formed_span: Column, formed_contact: Column) -> dict[str, Column]:
    """span, contact and width (low, high) of a part's seated lead, null where it is unknown, and whether its width was refused.

    A straight lead is formed by the assembler, who alone knows its span and foot; a gull-wing lead's are drawn; other
    forms have none. A lead wider than three quarters of the pitch was misread.
    """
    form, straight = c("lead_form"), c("lead_form") == "straight"
    pair = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    formed = lambda x: F.when(_positive(x), pair(x, x))
    drawn = lambda n: F.when(G.usable(c(f"{n}_min"), c(f"{n}_max")), pair(c(f"{n}_min"), c(f"{n}_max")))
    span = F.when(straight, formed(formed_span)).when(form == "gullwing", drawn("span"))
    contact = F.when(straight, formed(formed_contact)).otherwise(F.when(c("contact_min").isNotNull() & c("contact_max").isNotNull(), pair(c("contact_min"), c("contact_max"))))
    width = drawn("lead_width")
    whole = span.isNotNull() & contact.isNotNull() & width.isNotNull()
    too_wide = whole & F.coalesce((c("pitch") > 0) & (width["high"] > WIDEST_LEAD * c("pitch")), F.lit(False))
    kept = lambda x: F.when(whole & ~too_wide, x)
    return {"lead_span": kept(span), "lead_contact": kept(contact), "lead_width": kept(width), "lead_refused": too_wide}


def _pattern(level: str) -> Column:
    return G.land_pattern(*((c(f"lead_{n}.low"), c(f"lead_{n}.high")) for n in ("span", "contact", "width")), level)


def with_pattern(rows: DataFrame, name: str, level: str) -> DataFrame:
    """rows with the land pattern of their seated leads at a density, as a column."""
    return rows.withColumn(name, _pattern(level))


def in_band() -> Column:
    """Does the printed land reach, toe to toe, what the standard gives for the lead between its least and most density (_least, _most); null without a lead."""
    most, least, reach = c("_most"), c("_least"), c("land_span") + c("land_length")
    return F.when(most.isNotNull() & least.isNotNull(), (reach >= least["z"] - BAND) & (reach <= most["z"] + BAND))


def printed_gate() -> Column:
    """ok, none (not all printed), or why the printed land can't be: its numbers contradict each other or the part."""
    length, width, span, cross = c("land_length"), c("land_width"), c("land_span"), c("land_span_cross")
    return (
        F.when(~(_positive(length) & _positive(width) & _positive(span)), "none")
        .when(span - length <= 0, "rows meet")
        .when(~F.coalesce(c("in_band"), F.lit(True)), "outside the band")
        .when(F.coalesce((c("pitch") > 0) & (width >= c("pitch")), F.lit(False)), "lands touch")
        .when(cross.isNotNull() & ((cross <= 0) | (cross - length <= 0)), "cross rows meet")
        .otherwise("ok")
    )


def disagreements(printed: Column, values: dict[str, Column], tolerance: float = AGREEMENT) -> Column:
    """Which of the computed values no printed number comes near; values that are null are not asked about."""
    far = lambda v: v.isNotNull() & ~F.exists(printed, lambda p: F.abs(p - v) <= tolerance)
    return F.array_compact(F.array(*(F.when(far(v), F.lit(n)) for n, v in values.items())))


def judged(records: DataFrame, formed_span: str, formed_contact: str) -> DataFrame:
    """records with the seated lead, in_band and printed (see printed_gate)."""
    rows = records.withColumns(drawn_lead(c(formed_span), c(formed_contact)))
    rows = rows.withColumns({"_most": _pattern("A"), "_least": _pattern("C")})
    return rows.withColumn("in_band", in_band()).drop("_most", "_least").withColumn("printed", printed_gate())


def chosen(rows: DataFrame, key: str, level: str = "B") -> DataFrame:
    """key, source, needs: where each footprint comes from. rows: judged(), with declared_leads, outline_named, outline_drawn, exposed_pad, mounting, lead_sides and printed_mm.

    Contradictions refuse before anything is built: another package's pins, another package's drawing. Then what is
    printed comes first, what is computed from the drawing second if no printed number contradicts it; what neither
    gives is asked for.
    """
    rows = rows.withColumn("_land", _pattern(level))
    land = c("_land")  # a column of its own: it is looked at many times
    layout = F.coalesce((c("pitch") > 0) & c("lead_sides").isin(1, 2, 4), F.lit(False))
    against = disagreements(c("printed_mm"), {"land length": land["pad_length"], "land width": land["x"], "span": land["pad_centre"] * 2})
    contradicted = (F.size(F.coalesce("printed_mm", F.array().cast("array<double>"))) > 0) & (F.size(against) > 0)
    hole = c("mounting") == "through-hole"
    ask = lambda test, name: F.when(test, F.lit(name))
    thermal = c("exposed_pad") & (c("thermal_length").isNull() | c("thermal_width").isNull())
    of_hole = F.array_compact(F.array(ask(~c("lead_sides").isin(1, 2) | c("lead_sides").isNull(), "rows"), ask(c("lead_diameter").isNull(), "lead diameter"), ask((c("lead_sides") == 2) & c("land_span").isNull(), "row spacing"), ask(c("pitch").isNull(), "pitch")))
    of_land = F.array_compact(F.array(ask(c("pitch").isNull(), "pitch"), ask(c("lead_sides").isNull(), "sides"), ask(c("land_length").isNull(), "land length"), ask(c("land_width").isNull(), "land width"), ask(c("land_span").isNull(), "land span")))
    source = (
        F.when(F.coalesce(c("declared_leads") != c("pin_count"), F.lit(False)), "refused: other package")
        .when(F.coalesce(c("outline_named") != c("outline_drawn"), F.lit(False)), "refused: other drawing")
        .when(thermal, "ask")
        .when(hole, F.when(F.size(of_hole) == 0, "through-hole").otherwise("ask"))
        .when((c("printed") == "ok") & layout, "printed")
        .when(land.isNotNull() & layout & ~contradicted, "computed")
        .otherwise("ask")
    )
    needs = F.when(thermal, F.array_compact(F.array(ask(c("thermal_length").isNull(), "pad length"), ask(c("thermal_width").isNull(), "pad width")))).when(hole, of_hole).otherwise(of_land)
    return rows.select(key, source.alias("source"), F.when(source == "ask", needs).otherwise(F.array().cast("array<string>")).alias("needs"))


def vacant_pads(parts: DataFrame, key: str) -> DataFrame:
    """key, number, x, y of two rows of which the right one has an empty place. parts: n (odd), pitch, centre, vacant (1 .. slots, from the bottom)."""
    slots = F.ceil(c("n") / 2).cast("int")
    rows = parts.select(key, "pitch", "centre", "vacant", slots.alias("s"), F.explode(F.sequence(F.lit(1), c("n"))).alias("number"))
    left = c("number") <= c("s")
    nth = c("number") - c("s")
    slot = F.when(left, c("number") - 1).otherwise(c("s") - (nth + F.when(nth >= c("vacant"), 1).otherwise(0)))
    return rows.select(key, "number", F.when(left, -c("centre")).otherwise(c("centre")).alias("x"), (-(c("s") - 1) * c("pitch") / 2 + slot * c("pitch")).alias("y"))


def sided_pads(parts: DataFrame, key: str) -> DataFrame:
    """key, number, side (0 left, 1 bottom, 2 right, 3 top), along: four sides with leads counted one by one. parts: sides (array of 4 counts), pitch."""
    rows = parts.select(key, "pitch", "sides", F.posexplode("sides").alias("side", "count"))
    before = F.aggregate(F.slice("sides", F.lit(1), c("side")), F.lit(0), lambda a, n: a + n)
    rows = rows.where("count > 0").select(key, "pitch", "side", "count", before.alias("before"), F.explode(F.sequence(F.lit(1), c("count"))).alias("nth"))
    along = (c("nth") - (c("count") + 1) / 2) * c("pitch") * F.when(c("side") < 2, 1).otherwise(-1)
    return rows.select(key, (c("before") + c("nth")).alias("number"), "side", along.alias("along"))


def lines_of(pads: DataFrame, key: str, axis: str, eps: float = 0.005) -> DataFrame:
    """pads with `line`: lands whose coordinate is within eps of their neighbour's are in one row, numbered from 0."""
    w = Window.partitionBy(key).orderBy(axis)
    new = F.when(c(axis) - F.lag(axis).over(w) > eps, 1).otherwise(0)
    return pads.withColumn("_new", new).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def pitch_breaks(pads: DataFrame, key: str, across: str, along: str, pitch: str, eps: float = 0.005) -> DataFrame:
    """key, gaps, breaks: gaps between neighbours of a row, and how many are no whole number of pitches."""
    rows = lines_of(pads, key, across, eps)
    gap = c(along) - F.lag(along).over(Window.partitionBy(key, "line").orderBy(along))
    rows = rows.select(key, gap.alias("_g"), c(pitch).alias("_p")).where(c("_g").isNotNull())
    off = F.abs(c("_g") - F.round(c("_g") / c("_p")) * c("_p")) > eps
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("gaps"), F.count_if(off | (F.round(c("_g") / c("_p")) < 1)).alias("breaks"))


def altium_units(mm: Column) -> Column:
    """Millimetres as ten-thousandths of a mil; null where a coordinate doesn't fit, which must not be cut off."""
    units = F.round(mm / 0.0254 * UNITS_A_MIL)
    return F.when((units >= -INT32) & (units < INT32), units.cast("long"))


def fab_chamfer(width: Column, length: Column) -> Column:
    return F.least(F.lit(CHAMFER), CHAMFER_PART * F.least(width, length))


def courtyard_half(reach: Column, level: str) -> Column:
    return reach / 2 + G.COURTYARD[level]


def copper_check(pads: DataFrame, records: DataFrame, key: str, eps: float = 0.005) -> DataFrame:
    """key, pads, agrees: do the emitted lands say what the record says: count, centre span, sizes; null where it doesn't say."""
    seen = pads.groupBy(key).agg(F.count(F.lit(1)).alias("pads"), (F.max("x") - F.min("x")).alias("_span"), F.max("w").alias("_w"), F.max("h").alias("_h"))
    rows = records.join(seen, key)
    near = lambda a, b: F.abs(a - b) <= eps
    return rows.select(key, "pads", ((c("pads") == c("n")) & near(c("_span"), 2 * c("centre")) & near(c("_w"), c("pad_length")) & near(c("_h"), c("pad_width"))).alias("agrees"))


def silk(edges: DataFrame, pads: DataFrame, key: str, clearance: float) -> DataFrame:
    """key, edge, start, end: what is left of a body's vertical edges (edge, x, low, high) beside the lands, with a clearance around these."""
    a = edges.select(key, "edge", "low", "high", c("x").alias("_x"))
    b = pads.select(c(key).alias("_k"), (c("y") - c("h") / 2 - clearance).alias("_a"), (c("y") + c("h") / 2 + clearance).alias("_b"), (c("x") - c("w") / 2 - clearance).alias("_l"), (c("x") + c("w") / 2 + clearance).alias("_r"))
    near = (a[key] == b["_k"]) & (c("_l") < c("_x")) & (c("_x") < c("_r")) & (c("_a") < c("high")) & (c("_b") > c("low"))
    cut = F.when(c("_a").isNotNull(), F.struct("_a", "_b"))
    # lands are many times what Spark guesses them to be, and never broadcast
    rows = a.join(b.hint("merge"), near, "left").groupBy(key, "edge", "low", "high", "_x").agg(F.sort_array(F.collect_list(cut)).alias("_cuts"))
    # bounded by the part's pins: walk along the edge from cut to cut
    start = F.struct(F.col("low").alias("at"), F.array().cast("array<struct<start:double,end:double>>").alias("kept"))

    def walk(s: Column, cut: Column) -> Column:
        piece = F.when(cut["_a"] > s["at"], F.array(F.struct(s["at"].alias("start"), cut["_a"].alias("end")))).otherwise(F.array().cast("array<struct<start:double,end:double>>"))
        return F.struct(F.greatest(s["at"], cut["_b"]).alias("at"), F.concat(s["kept"], piece).alias("kept"))

    walked = rows.withColumn("_w", F.aggregate("_cuts", start, walk))
    last = F.when(c("_w.at") < c("high"), F.array(F.struct(c("_w.at").alias("start"), c("high").alias("end")))).otherwise(F.array().cast("array<struct<start:double,end:double>>"))
    return walked.select(key, "edge", F.explode(F.concat("_w.kept", last)).alias("s")).select(key, "edge", "s.start", "s.end")
