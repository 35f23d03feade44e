"""Checks of image annotations: sizes, containment, coverage and the ink that boxes should hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels darker than this are ink; the band of a room's box in which its walls stand; share of a page that the control is moved.
INK, BAND, SHIFT = 200, 6, 3
INSIDE, RATIO = 0.99, 1.5


def size_ratios(images: DataFrame) -> DataFrame:
    """``images`` (original_w, original_h, scaled_w, scaled_h) with the ratio of each axis; null without an original."""
    share = lambda a, b: F.when((F.col("original_w") > 0) & (F.col("original_h") > 0), F.col(a) / F.col(b))
    return images.withColumns({"ratio_w": share("scaled_w", "original_w"), "ratio_h": share("scaled_h", "original_h")})


def size_match(images: DataFrame) -> DataFrame:
    """(match, n): which file has the declared size (w, h), the original before the scaled one, else NONE; most common first."""
    same = lambda a: (F.col(f"{a}_w") == F.col("w")) & (F.col(f"{a}_h") == F.col("h"))
    match = F.when(same("original"), "original").when(same("scaled"), "scaled").otherwise("NONE")
    return images.groupBy(match.alias("match")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "match")


def control_box(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """A box (x, y, w, h) moved by a third of the page, around the range in which it fits."""
    moved = lambda at, size, page: F.pmod(at + page / SHIFT, F.greatest(F.lit(1), page - size).cast("double"))
    return F.struct(moved(x, w, page_w).alias("x"), moved(y, h, page_h).alias("y"), w.alias("w"), h.alias("h"))


def ink_fraction(gray: np.ndarray, x: float, y: float, w: float, h: float) -> float | None:
    """The share of ink inside a box, cut to the page; None if nothing of it is on the page."""
    part = gray[max(0, int(y)) : max(0, int(y + h)), max(0, int(x)) : max(0, int(x + w))]
    return float((part < INK).mean()) if part.size else None


def edge_and_inside(gray: np.ndarray, x: float, y: float, w: float, h: float, band: int = BAND) -> tuple[float | None, float | None]:
    """The share of ink in the outer band of a box and in its middle; None for a box without a middle."""
    x, y, w, h = (int(v) for v in (x, y, w, h))
    part = gray[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)] < INK
    if min(w, h, *part.shape) < 4 * band:
        return None, None
    middle = part[band:-band, band:-band]
    return float((part.sum() - middle.sum()) / (part.size - middle.size)), float(middle.mean())


def coverage(width: int, height: int, boxes: list[tuple[float, float, float, float]]) -> float:
    """The share of a page that the union of boxes (x, y, w, h) covers; both borders of a box belong to it."""
    page = np.zeros((height, width), bool)
    for x, y, w, h in boxes:
        x, y, w, h = (int(v) for v in (x, y, w, h))
        page[max(0, y) : max(0, min(height, y + h) + 1), max(0, x) : max(0, min(width, x + w) + 1)] = True
    return float(page.mean()) if page.size else 0.0


MEASURES = "image_id long, category string, real double, control double, edge double, inside double"


def measured(images: DataFrame, boxes: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """Ink of each box: walls against their moved controls, rooms at their edge against their middle.

    ``images`` has image_id, width, height and image, ``boxes`` image_id, category, x, y, w, h; ``decode`` gives gray values.
    An image that cannot be decoded has no measures.
    """
    control = control_box(*map(F.col, ("x", "y", "w", "h", "width", "height")))
    listed = boxes.join(images.select("image_id", "width", "height"), "image_id")
    listed = listed.groupBy("image_id").agg(F.collect_list(F.struct("category", "x", "y", "w", "h", control.alias("moved"))).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for image, content, own in zip(batch["image_id"], batch["image"], batch["boxes"], strict=True):
                try:
                    gray = decode(content)
                except Exception:  # noqa: S112  the other images still count
                    continue
                for b in own:
                    at = (b["x"], b["y"], b["w"], b["h"])
                    if b["category"] == "wall":
                        out.append((image, "wall", ink_fraction(gray, *at), ink_fraction(gray, *(b["moved"][c] for c in "xywh")), None, None))
                    elif b["category"] == "room":
                        out.append((image, "room", None, None, *edge_and_inside(gray, *at)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MEASURES.split(", ")])

    return images.select("image_id", "image").join(listed, "image_id").mapInPandas(run, MEASURES)


def verdict(measures: DataFrame, matches: DataFrame, contained: DataFrame) -> DataFrame:
    """(wall_ratio, edge_ratio, match, inside, aligned): whether annotations lie on what they describe.

    ``matches`` as from ``size_match`` and ``contained`` (inside, n), both a few rows.
    """
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    small = lambda c: F.greatest(c, F.lit(1e-9))
    m = measures.agg((mean("real") / small(mean("control"))).alias("wall_ratio"), (mean("edge") / small(mean("inside"))).alias("edge_ratio"))
    best = matches.agg(F.max_by("match", F.struct("n", F.col("match") != "NONE")).alias("match"))
    share = contained.select(F.coalesce(F.try_divide("inside", "n"), F.lit(0.0)).alias("inside"))
    both = m.join(F.broadcast(best)).join(F.broadcast(share))  # one row each
    good = (F.col("match") != "NONE") & (F.col("inside") > INSIDE) & (F.col("wall_ratio") > RATIO) & (F.col("edge_ratio") > RATIO)
    return both.withColumn("aligned", F.coalesce(good, F.lit(False)))
