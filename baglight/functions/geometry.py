"""Box and score expressions. Boxes are four columns (x1, y1, x2, y2) or a struct with these fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The four columns of a table or of an alias."""
    p = f"{prefix}." if prefix else ""
    return tuple(F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2"))


def fields(b: Column) -> Box:
    return b["x1"], b["y1"], b["x2"], b["y2"]


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Box, b: Box) -> Column:
    """Overlap by union; the union is at least 1e-6."""
    both = overlap(a, b)
    return both / F.greatest(area(a) + area(b) - both, F.lit(1e-6))


def ioa(a: Box, b: Box) -> Column:
    """Overlap by the area of a, which is at least 1e-6."""
    return overlap(a, b) / F.greatest(area(a), F.lit(1e-6))


def square_region(b: Box, factor: float, least: float) -> Column:
    """Struct of the square around the box's centre, of side factor times its longer side, at least `least`."""
    side = F.greatest(F.greatest(b[2] - b[0], b[3] - b[1]) * factor, F.lit(float(least)))
    cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    return F.struct((cx - side / 2).alias("x1"), (cy - side / 2).alias("y1"), (cx + side / 2).alias("x2"), (cy + side / 2).alias("y2"))


def letterbox(w: Column, h: Column, size: int) -> Column:
    """Struct scale, pad_x, pad_y of fitting a w x h picture into a square; sides are rounded half to even. Null without a size."""
    ok = (w > 0) & (h > 0)
    scale = F.least(F.lit(float(size)) / w, F.lit(float(size)) / h)
    pad = lambda side: F.floor((F.lit(size) - F.greatest(F.bround(side * scale), F.lit(1.0))) / 2).cast("int")
    return F.when(ok, F.struct(scale.alias("scale"), pad(w).alias("pad_x"), pad(h).alias("pad_y")))


def to_cache(b: Box, scale: Column, pad_x: Column, pad_y: Column) -> Box:
    return b[0] * scale + pad_x, b[1] * scale + pad_y, b[2] * scale + pad_x, b[3] * scale + pad_y


def from_cache(b: Box, scale: Column, pad_x: Column, pad_y: Column, w: Column, h: Column) -> Box:
    """Back to the picture, cut off at its edges."""
    back = lambda v, pad, top: F.least(F.greatest((v - pad) / scale, F.lit(0.0)), top)
    return back(b[0], pad_x, w), back(b[1], pad_y, h), back(b[2], pad_x, w), back(b[3], pad_y, h)


def resolve_box(v: list[Column], layout: str, w: Column, h: Column) -> Column:
    """Struct of a raw list of four numbers read as corners ('xyxy') or corner and size ('xywh').

    Numbers all within 1.5 are shares of the picture; corners are put in order and cut off at the
    picture; null when a side is left with less than a pixel.
    """
    share = F.greatest(*[F.abs(x) for x in v]) <= 1.5
    a, b, c, e = (F.when(share, x * s).otherwise(x) for x, s in zip(v, (w, h, w, h), strict=True))
    if layout == "xywh":
        c, e = a + c, b + e
    cut = lambda x, top: F.least(F.greatest(x, F.lit(0.0)), top)
    x1, y1, x2, y2 = cut(F.least(a, c), w), cut(F.least(b, e), h), cut(F.greatest(a, c), w), cut(F.greatest(b, e), h)
    made = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return F.when((x2 - x1 >= 1) & (y2 - y1 >= 1), made)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))
