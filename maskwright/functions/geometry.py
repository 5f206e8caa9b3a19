"""Boxes: structs (x, y, width, height) or arrays [x, y, w, h], relative to the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAME_LINE = 0.01
BOX = "array<double>"


def box(x, y, w, h) -> Column:
    return F.array(*[c.cast("double") if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, w, h)])


def valid(b: Column) -> Column:
    return b.isNotNull() & (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull())


def union(boxes: Column) -> Column:
    """The smallest box around all valid ones; null without any."""
    ok = F.filter(boxes, valid)
    at = lambda f: F.transform(ok, f)
    x, y = F.array_min(at(lambda b: b[0])), F.array_min(at(lambda b: b[1]))
    right, bottom = F.array_max(at(lambda b: b[0] + b[2])), F.array_max(at(lambda b: b[1] + b[3]))
    return F.when(F.size(ok) > 0, F.array(x, y, right - x, bottom - y))


def merge_lines(boxes: Column, threshold: float = SAME_LINE) -> Column:
    """One box a line: in (y, x) order, a box further down than the threshold from its line's first box starts a new one."""
    order = F.transform(F.array_sort(F.transform(F.filter(boxes, valid), lambda b: F.struct(b[1].alias("y"), b[0].alias("x"), b.alias("b")))), lambda s: s["b"])
    # A line is the y of its first box and its own sides; its boxes are not kept.
    line = "struct<y:double,x0:double,y0:double,x1:double,y1:double>"
    none = F.struct(F.array().cast(f"array<{line}>").alias("done"), F.lit(None).cast(line).alias("line"))
    side = lambda b: (b[0], b[1], b[0] + b[2], b[1] + b[3])
    struct = lambda y, sides: F.struct(y.alias("y"), *[v.alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), sides)])
    ended = lambda acc: F.when(acc["line"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"])))

    def step(acc, b):
        own, (x0, y0, x1, y1) = acc["line"], side(b)
        grown = struct(own["y"], (F.least(own["x0"], x0), F.least(own["y0"], y0), F.greatest(own["x1"], x1), F.greatest(own["y1"], y1)))
        same = own.isNotNull() & (F.abs(b[1] - own["y"]) <= threshold)
        return F.when(same, F.struct(acc["done"].alias("done"), grown.alias("line"))).otherwise(F.struct(ended(acc).alias("done"), struct(b[1], side(b)).alias("line")))

    lines = F.aggregate(order, none, step, ended)
    return F.transform(lines, lambda n: F.array(n["x0"], n["y0"], n["x1"] - n["x0"], n["y1"] - n["y0"]))


def from_polygon(p: Column) -> Column:
    """Four corners as eight numbers; fewer give a zero box."""
    xs, ys = F.filter(p, lambda v, i: i % 2 == 0), F.filter(p, lambda v, i: i % 2 == 1)
    whole = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    # Four corners need no lambdas.
    x, y = ([F.get(p, i) for i in range(k, 8, 2)] for k in (0, 1))
    four = F.array(F.least(*x), F.least(*y), F.greatest(*x) - F.least(*x), F.greatest(*y) - F.least(*y))
    return F.when(F.size(p) == 8, four).when(F.size(F.coalesce(p, F.array().cast(BOX))) >= 8, whole).otherwise(F.array(*[F.lit(0.0)] * 4))


def to_unit(b: Column, width: Column, height: Column) -> Column:
    """Pixels as shares of the page; null for a page without extent."""
    w, h = F.nullif(width.cast("double"), F.lit(0.0)), F.nullif(height.cast("double"), F.lit(0.0))
    return F.array(b[0] / w, b[1] / h, b[2] / w, b[3] / h)


def contained_share(child: Column, parent: Column) -> Column:
    """Overlap as a share of the child's area; a child without area is contained."""
    over = lambda i, j: F.greatest(F.lit(0.0), F.least(child[i] + child[j], parent[i] + parent[j]) - F.greatest(child[i], parent[i]))
    area = child[2] * child[3]
    return F.when(area <= 0, F.lit(1.0)).otherwise(over(0, 2) * over(1, 3) / area)


def intersects(a0, a1, a2, a3, b0, b1, b2, b3) -> Column:
    """Rectangles (x0, y0, x1, y1) that share an area."""
    return (F.greatest(a0, b0) < F.least(a2, b2)) & (F.greatest(a1, b1) < F.least(a3, b3))


def rounded(b: Column, digits: int = 3) -> Column:
    return F.transform(b, lambda v: F.bround(v, digits))


def fitted(width: Column, height: Column, longest: int = 1024) -> tuple[Column, Column]:
    """Image size within the longest side, never larger than it is."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.nullif(F.greatest(width, height).cast("double"), F.lit(0.0)))
    return tuple(F.floor(v * scale).cast("int") for v in (width, height))


def to_pixels(b: Column, width: Column, height: Column, padding: int = 2) -> Column:
    """Pixel rectangle (x0, y0, x1, y1) of a relative box, padded and clamped to the page."""
    cut = lambda v: v.cast("int")
    x0, y0 = F.greatest(F.lit(0), cut(b[0] * width) - padding), F.greatest(F.lit(0), cut(b[1] * height) - padding)
    x1, y1 = F.least(width.cast("int"), cut((b[0] + b[2]) * width) + padding), F.least(height.cast("int"), cut((b[1] + b[3]) * height) + padding)
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def font_size(height: Column) -> Column:
    return F.greatest(F.lit(6), F.least(F.lit(36), (height * 0.7).cast("int")))


def text_origin(rotation: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Where replacement text starts on a page turned by 0, 90, 180 or 270 degrees, 2 units inside the rectangle."""
    x = F.when(rotation == 180, x1 - 2).otherwise(x0 + 2)
    y = F.when(rotation == 270, y0 + 2).otherwise(y1 - 2)
    return F.struct(x.alias("x"), y.alias("y"))
