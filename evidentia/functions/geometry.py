"""Land-pattern arithmetic as column expressions, in millimetres and doubles. A result that cannot be is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values by density level: toe, heel and side fillets of gull-wing leads, courtyard excess, hole allowance, annular ring.
FILLETS = {"A": (0.55, 0.45, 0.05), "B": (0.35, 0.35, 0.03), "C": (0.15, 0.25, 0.01)}
COURTYARD = {"A": 0.5, "B": 0.25, "C": 0.12}
HOLE = {"A": 0.25, "B": 0.2, "C": 0.15}
RING = {"A": 0.5, "B": 0.4, "C": 0.25}
#: Fabrication and placement tolerance, paste coverage, largest and smallest paste aperture.
FABRICATION, PLACEMENT, COVERAGE, APERTURE_MAX, APERTURE_MIN = 0.05, 0.025, 0.65, 1.5, 0.25


def rss(spread: Column) -> Column:
    return F.sqrt(spread * spread + FABRICATION * FABRICATION + PLACEMENT * PLACEMENT)


def usable(low: Column, high: Column) -> Column:
    return F.coalesce((low > 0) & (high >= low) & ~F.isnan(low) & ~F.isnan(high) & (high < float("inf")), F.lit(False))


def land_pattern(span: tuple[Column, Column], contact: tuple[Column, Column], width: tuple[Column, Column], level: str) -> Column:
    """struct z, g, x, pad_length, pad_centre, or null if an input is missing or inconsistent."""
    toe, heel, side = FILLETS[level]
    inner_min, inner_max = span[0] - 2 * contact[1], span[1] - 2 * contact[0]
    z = span[0] + 2 * toe + rss(span[1] - span[0])
    g = inner_max - 2 * heel - rss(inner_max - inner_min)
    x = width[0] + 2 * side + rss(width[1] - width[0])
    sound = usable(*span) & usable(*contact) & usable(*width) & F.coalesce((inner_min > 0) & (g > 0) & (z > g), F.lit(False))
    return F.when(sound, F.struct(z.alias("z"), g.alias("g"), x.alias("x"), ((z - g) / 2).alias("pad_length"), ((z + g) / 4).alias("pad_centre")))


def through_hole(lead: Column, level: str) -> Column:
    """struct drill, pad of a round lead."""
    drill = lead + HOLE[level]
    return F.when(lead > 0, F.struct(drill.alias("drill"), (drill + 2 * RING[level]).alias("pad")))


def paste_cells(extent: Column) -> Column:
    """Paste apertures along an axis: as few as keep each at or under the largest, but no more than keep each at or over the smallest."""
    solder = extent * (COVERAGE**0.5)
    fewest = F.greatest(F.lit(1), F.ceil(solder / APERTURE_MAX).cast("int"))
    most = F.greatest(F.lit(1), F.floor(solder / APERTURE_MIN + 1e-9).cast("int"))
    return F.least(fewest, most)


def overlaps(a: dict[str, Column], b: dict[str, Column], touching: float = 1e-6) -> Column:
    """Do two rectangles (x, y of the centre, w, h) overlap by more than a touch?"""

    def axis(p: str, s: str) -> Column:
        return (a[p] - a[s] / 2 < b[p] + b[s] / 2 - touching) & (b[p] - b[s] / 2 < a[p] + a[s] / 2 - touching)

    return axis("x", "w") & axis("y", "h")
