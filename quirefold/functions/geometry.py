"""Boxes (origin at the bottom left), affine placements and their predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _span(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def same_line(first: Column, second: Column) -> Column:
    """Vertical overlap of 0.65 of the smaller height, and a gap of -2 to 18."""
    overlap = F.greatest(F.lit(0.0), F.least(first["top"], second["top"]) - F.greatest(first["bottom"], second["bottom"]))
    height = F.least(F.greatest(F.lit(0.01), first["top"] - first["bottom"]), F.greatest(F.lit(0.01), second["top"] - second["bottom"]))
    return F.coalesce((overlap / height >= 0.65) & (second["left"] - first["right"]).between(-2, 18), F.lit(False))


def fragments_touch(first: Column, second: Column) -> Column:
    """Vertical overlap of a quarter of the smaller height, with horizontal overlap or a gap of 8 at most."""
    a, b = _span(first["top"], first["bottom"]), _span(second["top"], second["bottom"])
    overlap = F.greatest(F.lit(0.0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(1.0), F.least(a[1] - a[0], b[1] - b[0]))
    across = F.least(first["right"], second["right"]) - F.greatest(first["left"], second["left"])
    return F.coalesce((overlap / height >= 0.25) & (across >= -8), F.lit(False))


def overlap_ratio(block: Column, image: Column) -> Column:
    """Area of the intersection by the area of the block, which counts as 1 at least."""
    a, b = _span(block["bottom"], block["top"]), _span(image["bottom"], image["top"])
    width = F.greatest(F.lit(0.0), F.least(block["right"], image["right"]) - F.greatest(block["left"], image["left"]))
    height = F.greatest(F.lit(0.0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]))
    area = F.greatest(F.lit(1.0), F.abs(block["right"] - block["left"]) * F.abs(block["top"] - block["bottom"]))
    return F.coalesce(width * height / area, F.lit(0.0))


def in_box(x: Column, y: Column, box: Column) -> Column:
    """Whether a point is in a box, with a margin of 1.5 % of its height, 3 at least."""
    margin = F.greatest(F.lit(3.0), F.abs(box["top"] - box["bottom"]) * 0.015)
    return F.coalesce(x.between(box["left"] - margin, box["right"] + margin) & y.between(box["bottom"] - margin, box["top"] + margin), F.lit(False))


def union_of(boxes: Column) -> Column:
    """The least box around all boxes of an array; null if it has none."""
    some = F.filter(boxes, lambda b: b.isNotNull())
    pick = lambda f, name: f(F.transform(some, lambda b: b[name]))
    around = F.struct(pick(F.array_min, "left").alias("left"), pick(F.array_max, "top").alias("top"), pick(F.array_max, "right").alias("right"), pick(F.array_min, "bottom").alias("bottom"))
    return F.when(F.size(some) > 0, around)


def multiply(first: Column, second: Column) -> Column:
    """Product of two affine matrices (a, b, c, d, e, f), the first applied first."""
    a, b = ([m[k] for k in range(6)] for m in (first, second))
    return F.array(
        *(a[2 * r] * b[c] + a[2 * r + 1] * b[2 + c] + (b[4 + c] if r == 2 else F.lit(0.0)) for r in range(3) for c in range(2)),
    )


def transform(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def image_to_page(m: Column, width: Column, height: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point of an image (origin at the top left) on its page, by the placement of the image's unit square."""
    return transform(m, x / width, 1 - y / height)


def placed_box(m: Column) -> Column:
    """The box on the page of an image's unit square."""
    corners = [transform(m, F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.struct(F.least(*xs).alias("left"), F.greatest(*ys).alias("top"), F.greatest(*xs).alias("right"), F.least(*ys).alias("bottom"))


def is_tiny_picture(box: Column) -> Column:
    width, height = F.greatest(F.lit(0.0), box["right"] - box["left"]), F.greatest(F.lit(0.0), box["top"] - box["bottom"])
    return F.coalesce((width < 24) | (height < 18) | (width * height < 500), F.lit(False))
