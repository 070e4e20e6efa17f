"""Texts of CAD files and log lines, one row each, made by expressions."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_template() -> str:
    """The template of a closed box: %1$s to %6$s stand for the least and greatest x, y and z, %7$s for its name."""
    number, lines = count(10), []

    def add(text: str) -> str:
        n = f"#{next(number)}"
        lines.append(f"{n}={text};")
        return n

    at = [("%1$s", "%2$s"), ("%3$s", "%4$s"), ("%5$s", "%6$s")]
    corners = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    points = {c: add(f"CARTESIAN_POINT('',({','.join(at[a][c[a]] for a in range(3))}))") for c in corners}
    vertices = {c: add(f"VERTEX_POINT('',{points[c]})") for c in corners}
    unit = {(a, s): add(f"DIRECTION('',({','.join(f'{s}.' if b == a else '0.' for b in range(3))}))") for a in range(3) for s in (1, -1)}
    edges = {}
    for c in corners:
        for a in range(3):
            if c[a] == 0:
                other = tuple(1 if b == a else c[b] for b in range(3))
                line = add(f"LINE('',{points[c]},{add(f'VECTOR({chr(39) * 2},{unit[a, 1]},1.)')})")
                edges[c, other] = add(f"EDGE_CURVE('',{vertices[c]},{vertices[other]},{line},.T.)")
    faces = []
    for a in range(3):
        for side in (0, 1):
            u, v = [b for b in range(3) if b != a]
            loop = []
            for i, j in ((0, 0), (1, 0), (1, 1), (0, 1)):
                c = [0, 0, 0]
                c[a], c[u], c[v] = side, i, j
                loop.append(tuple(c))
            # seen from outside counter-clockwise: u, v, a turn right-handed unless a is the middle axis
            if (side == 1) == (a == 1):
                loop.reverse()
            oriented = []
            for p, q in zip(loop, [*loop[1:], loop[0]], strict=True):
                forward = (p, q) in edges
                oriented.append(add(f"ORIENTED_EDGE('',*,*,{edges[(p, q) if forward else (q, p)]},{'.T.' if forward else '.F.'})"))
            bound = add(f"FACE_OUTER_BOUND('',{add(f'EDGE_LOOP({chr(39) * 2},({",".join(oriented)}))')},.T.)")
            plane = add(f"PLANE('',{add(f'AXIS2_PLACEMENT_3D({chr(39) * 2},{points[loop[0]]},{unit[a, 1 if side else -1]},{unit[u, 1]})')})")
            faces.append(add(f"ADVANCED_FACE('',({bound}),{plane},.T.)"))
    add(f"MANIFOLD_SOLID_BREP('%7$s',{add(f'CLOSED_SHELL({chr(39) * 2},({",".join(faces)}))')})")
    head = "ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION((''),'2;1');\nFILE_NAME('%7$s','1970-01-01T00:00:00',(''),(''),'','','');\nFILE_SCHEMA(('AUTOMOTIVE_DESIGN'));\nENDSEC;\nDATA;\n"
    return head + "\n".join(lines) + "\nENDSEC;\nEND-ISO-10303-21;\n"


def step_number(value: Column) -> Column:
    """Up to six places without trailing zeros, and always with a point."""
    return F.regexp_replace(F.format_string("%.6f", value), "0+$", "")


def step_string(value: Column) -> Column:
    return F.regexp_replace(F.replace(value, F.lit("'"), F.lit("''")), r"[\x00-\x1f\\]", " ")


def step_solids(parts: DataFrame, key: str, name: str, length: str, width: str, height: str) -> DataFrame:
    """key, body: a box of each part's size, standing on the board and centred on its origin; no row without all three sizes."""
    known = parts.where((F.col(length) > 0) & (F.col(width) > 0) & (F.col(height) > 0))
    half = [(-F.col(s) / 2, F.col(s) / 2) for s in (length, width)] + [(F.lit(0.0), F.col(height).cast("double"))]
    numbers = [step_number(v) for pair in half for v in pair]
    return known.select(key, F.format_string(box_template(), *numbers, step_string(F.col(name))).alias("body"))


#: The kinds of pins as the schematic format spells them; any other kind is unspecified.
PIN_KINDS = {"input": "input", "output": "output", "bidirectional": "bidirectional", "power": "power_in", "ground": "power_in", "passive": "passive", "no_connect": "no_connect"}


def symbol_text(parts: DataFrame, pins: DataFrame, key: str, name: str, grid: float = 2.54) -> DataFrame:
    """key, body: a two-sided schematic symbol, pins on a grid; the left half of the numbers down, the right half up.

    pins: key, number (long), pin_name, kind.
    """
    rows = pins.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    side = F.ceil(F.col("_n") / 2)
    left = F.col("number") <= side
    row = F.when(left, F.col("number") - 1).otherwise(F.col("_n") - F.col("number"))
    y = ((side - 1) / 2 - row) * grid
    kind = F.lit("unspecified")
    for k, v in PIN_KINDS.items():
        kind = F.when(F.col("kind") == k, v).otherwise(kind)
    quoted = F.regexp_replace("pin_name", r'(["\\])', r"\\$1")
    line = F.format_string('    (pin %s line (at %.2f %.2f %d) (length 2.54) (name "%s") (number "%d"))', kind, F.when(left, -10.16).otherwise(10.16), y, F.when(left, 0).otherwise(180), quoted, F.col("number"))
    listed = rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("number", line.alias("line"))))["line"], "\n").alias("_l"))
    # texts are many times what Spark guesses them to be, and never broadcast
    return parts.join(listed.hint("merge"), key).select(key, F.concat(F.lit('(symbol "'), F.regexp_replace(name, r'(["\\])', r"\\$1"), F.lit('"\n'), "_l", F.lit("\n)")).alias("body"))


def scrubbed(events: DataFrame, forbidden: list[str], part: str | None = None, parts_allowed: bool = False) -> DataFrame:
    """Log lines as JSON: forbidden columns never, the part number only where it is allowed."""
    gone = {f.lower() for f in forbidden} | ({part.lower()} if part and not parts_allowed else set())
    return events.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in events.columns if c.lower() not in gone))).alias("line"))


def footprint_file(parts: DataFrame, pads: DataFrame, silk: DataFrame, key: str, name: str) -> DataFrame:
    """key, body: a whole footprint: courtyard, outline of the body, silkscreen, pads, solid; lines in a fixed order, so equal parts give equal bytes.

    parts: half_width, half_height (courtyard), body_width, body_length; silk: key, x, start, end.
    """
    xy = lambda fmt, *v: F.format_string(fmt, *v)
    box = lambda layer, w, h: xy(f'  (fp_rect (start %.3f %.3f) (end %.3f %.3f) (layer "{layer}"))', -w, -h, w, h)
    pad = F.when(F.col("drill").isNull(), xy('  (pad "%d" smd rect (at %.3f %.3f) (size %.3f %.3f) (layers "F.Cu" "F.Paste" "F.Mask"))', "number", "x", "y", "w", "h")).otherwise(
        xy('  (pad "%d" thru_hole circle (at %.3f %.3f) (size %.3f %.3f) (drill %.3f) (layers "*.Cu" "*.Mask"))', "number", "x", "y", "w", "h", F.coalesce("drill", F.lit(0.0)))
    )
    listed = lambda rows, order, line, out: rows.select(key, F.struct(*order, line.alias("line")).alias("_r")).groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("_r"))["line"], "\n").alias(out))
    pads_ = listed(pads, ["number"], pad, "_pads")
    lines = listed(silk, ["x", "start"], xy('  (fp_line (start %.3f %.3f) (end %.3f %.3f) (layer "F.SilkS"))', "x", "start", "x", "end"), "_silk")
    quoted = F.regexp_replace(name, r'(["\\])', r"\\$1")
    rows = parts.join(pads_.hint("merge"), key).join(lines.hint("merge"), key, "left")  # many times what Spark guesses them to be, and never broadcast
    body = F.concat_ws(
        "\n", F.concat(F.lit('(footprint "'), quoted, F.lit('"')), F.lit('  (layer "F.Cu")'), box("F.CrtYd", F.col("half_width"), F.col("half_height")), box("F.Fab", F.col("body_width") / 2, F.col("body_length") / 2),
        F.col("_silk"), F.col("_pads"), F.concat(F.lit('  (model "'), quoted, F.lit('.step"))')),
    )
    return rows.select(key, body.alias("body"))


def bundle(files: DataFrame, key: str, path: str, body: str) -> DataFrame:
    """key, manifest: what an export consists of, as JSON: each file with its bytes and hash, in the order of their paths. No time stands in it."""
    one = F.struct(F.col(path).alias("path"), F.octet_length(body).alias("bytes"), F.sha2(body, 256).alias("sha256"))
    listed = files.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("files"))
    return listed.select(key, F.to_json(F.struct(F.lit(1).alias("version"), "files")).alias("manifest"))


def le32(value: Column) -> Column:
    """A whole number as four bytes, the least first, in hex."""
    v, byte = value.cast("long"), F.lit(0xFF)
    turned = [F.shiftleft(F.shiftright(v, 8 * k).bitwiseAND(byte), 24 - 8 * k) for k in range(4)]
    return F.lpad(F.hex(turned[0].bitwiseOR(turned[1]).bitwiseOR(turned[2]).bitwiseOR(turned[3])), 8, "0")


def short_string(value: Column) -> Column:
    """A string of at most 255 bytes with its length before it, in hex; null if it is longer."""
    raw = F.hex(F.encode(value, "UTF-8"))
    return F.when(F.length(raw) <= 510, F.concat(F.lpad(F.hex((F.length(raw) / 2).cast("long")), 2, "0"), raw))


def pad_records(pads: DataFrame, key: str) -> DataFrame:
    """key, hex: the lands of a part as binary records one after another: a length, then layer, place and size in file units, and the name.

    A land whose coordinates do not fit makes the whole null: a cut-off number would be another land.
    """
    from .footprint import altium_units

    # step by step, each value a column of its own: written out, each would be worked out hundreds of times
    rows = pads.select(key, "number", *(altium_units(F.col(n)).alias(f"_{n}") for n in "xywh"), short_string(F.col("number").cast("string")).alias("_s"))
    rows = rows.select(key, "number", F.concat(F.lit("01"), *(le32(F.col(f"_{n}")) for n in "xywh"), "_s").alias("_b"))
    rows = rows.select(key, "number", "_b", (F.length("_b") / 2).cast("long").alias("_n"))
    rows = rows.select(key, "number", F.concat(le32(F.col("_n")), "_b").alias("_r"))
    listed = F.array_join(F.sort_array(F.collect_list(F.struct("number", "_r")))["_r"], "")
    return rows.groupBy(key).agg(F.when(F.count_if(F.col("_r").isNull()) == 0, listed).alias("hex"))
