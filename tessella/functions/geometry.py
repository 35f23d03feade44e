"""Boxes, polygons and image sizes, as column expressions over structs of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")
#: Weight of vertical distance, and the reach of a label in its own heights.
VERTICAL, REACH = 0.6, 6
ASPECT = 1.2


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in BOX])


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return F.greatest(width(b), F.lit(0)) * F.greatest(height(b), F.lit(0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when((common == 0) | (union <= 0), 0.0).otherwise(common / union)


def overlaps(a: Column, b: Column) -> Column:
    """Whether closed boxes meet; touching counts."""
    return (a["x2"] >= b["x1"]) & (b["x2"] >= a["x1"]) & (a["y2"] >= b["y1"]) & (b["y2"] >= a["y1"])


def label_height(b: Column) -> Column:
    return F.greatest(F.least(width(b), height(b)), F.lit(1))


def distance_key(a: Column, b: Column) -> Column:
    """100 times the squared weighted distance of the centres, an exact integer that ranks like the distance."""
    dx, dy = a["x1"] + a["x2"] - b["x1"] - b["x2"], a["y1"] + a["y2"] - b["y1"] - b["y2"]
    return (dx * dx * 25 + dy * dy * 9).cast("long")


def reach_key(b: Column) -> Column:
    """The greatest distance_key that a label of this box reaches."""
    return (label_height(b) * label_height(b) * (100 * REACH * REACH)).cast("long")


def shape(b: Column, ratio: float = ASPECT) -> Column:
    return F.when(height(b) > width(b) * ratio, "tall").when(width(b) > height(b) * ratio, "wide").otherwise("square")


def plausible_angle(b: Column, angle: Column, rule: str = "tall_only") -> Column:
    """Whether a reading at this angle can be right for the shape of its box."""
    if rule == "off":
        return F.lit(True)
    wide = angle.isin(0, 180) if rule == "both" else F.lit(True)
    return F.when(shape(b) == "tall", angle.isin(90, 270)).when(shape(b) == "wide", wide).otherwise(True)


def unrotate(x: Column, y: Column, angle: Column, h: Column, w: Column) -> Column:
    """A point of a rotated page on the page itself; null for other angles than 0, 90, 180 and 270."""
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.when(angle == 0, point(x, y)).when(angle == 90, point(y, h - 1 - x)).when(angle == 180, point(w - 1 - x, h - 1 - y)).when(angle == 270, point(w - 1 - y, x))


def unrotate_box(b: Column, angle: Column, h: Column, w: Column) -> Column:
    p, q = unrotate(b["x1"], b["y1"], angle, h, w), unrotate(b["x2"], b["y2"], angle, h, w)
    low = lambda c: F.greatest(F.least(p[c], q[c]), F.lit(0)).cast("int")
    high = lambda c, most: F.least(F.greatest(p[c], q[c]), most).cast("int")
    return F.struct(low("x").alias("x1"), low("y").alias("y1"), high("x", w).alias("x2"), high("y", h).alias("y2"))


def shoelace(points: Column) -> Column:
    """Twice the area of a polygon given as an array of (x, y); fewer than three points have none."""
    turned = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(points) < 3, 0).otherwise(F.abs(F.aggregate(cross, F.lit(0).cast("double"), lambda t, x: t + x)))


def parse_points(text: Column) -> Column:
    """The points of an SVG polygon; entries without a comma or that are no numbers are passed over."""
    split = F.transform(F.split(F.trim(text), r"\s+"), lambda p: F.struct(F.split_part(p, F.lit(","), F.lit(1)).try_cast("double").alias("x"), F.split_part(p, F.lit(","), F.lit(2)).try_cast("double").alias("y")))
    return F.filter(split, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def image_tokens(w: Column, h: Column) -> Column:
    return (w * h / 750).cast("int")


def fold_angle(angle: Column) -> Column:
    """An angle of a line as a skew in [-45, 45)."""
    return F.pmod(angle + 45, F.lit(90)) - 45


def capped_size(w: Column, h: Column, edge: int) -> Column:
    """Width and height with the longer one brought down to ``edge``, truncated."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(w, h))
    return F.struct((w * scale).cast("int").alias("w"), (h * scale).cast("int").alias("h"))


def close_to(value: Column, other: Column, tolerance) -> Column:
    """Whether a value lies within a share of the other."""
    return F.abs(value - other) <= F.lit(tolerance) * F.greatest(F.abs(other), F.lit(1e-6))
