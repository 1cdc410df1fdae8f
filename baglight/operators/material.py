"""Pixel colours and losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Struct h, s, v of red, green and blue in [0, 1]; of equal channels red comes first, then green."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    raw = F.when(r == top, (g - b) / (d + EPS)).when(g == top, 2 + (b - r) / (d + EPS)).otherwise(4 + (r - g) / (d + EPS))
    return F.struct(F.pmod(raw / 6, F.lit(1.0)).alias("h"), (d / (top + EPS)).alias("s"), top.alias("v"))


def hue_histogram(pixels: DataFrame, bins: int = 72, least_s: float = 0.25, least_v: float = 0.15) -> DataFrame:
    """bin, share of the coloured pixels (h, s, v)."""
    ok = pixels.filter((F.col("s") > least_s) & (F.col("v") > least_v))
    n = ok.groupBy(F.least(F.floor(F.col("h") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return n.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # a row a bin


def membership(h: Column, s: Column, centre: float, spread: float, gate: float = 0.15) -> Column:
    """How much a hue belongs to a material: a bell over the circle of hues, faded out for grey pixels."""
    gap = F.abs(h - centre)
    gap = F.least(gap, 1 - gap)
    return F.exp(-0.5 * (gap / spread) * (gap / spread)) * F.least(s / gate, F.lit(1.0))


def asymmetric_loss(y: Column, p: Column, down: float = 4.0, up: float = 0.0, shift: float = 0.05) -> Column:
    """Loss of one score: negatives are shifted and weighed by their score to the power `down`, positives by `up`."""
    q = F.least(1 - p + shift, F.lit(1.0))
    clip = lambda x: F.greatest(x, F.lit(1e-8))
    return -(y * F.pow(1 - p, F.lit(up)) * F.ln(clip(p)) + (1 - y) * F.pow(1 - q, F.lit(down)) * F.ln(clip(q)))


def focal_loss(y: Column, p: Column, gamma: float = 2.0) -> Column:
    right = F.when(y == 1, p).otherwise(1 - p)
    return -F.pow(1 - right, F.lit(gamma)) * F.ln(F.greatest(right, F.lit(1e-8)))


def balanced_weights(counts: DataFrame, beta: float = 0.999) -> DataFrame:
    """cls, weight: (1 - beta) / (1 - beta ** n) with n at least 1, brought to mean 1."""
    raw = (1 - beta) / (1 - F.pow(F.lit(beta), F.greatest("n", F.lit(1)).cast("double")))
    return counts.select("cls", raw.alias("w")).select("cls", (F.col("w") / F.avg("w").over(Window.partitionBy())).alias("weight"))  # a row a class


def softmax(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Adds share: exp(value - max) over the sum of its group."""
    w = Window.partitionBy(by)
    return rows.withColumn("e", F.exp(F.col(value) - F.max(value).over(w))).withColumn("share", F.col("e") / F.sum("e").over(w)).drop("e")


def cross_entropy(y: Column, p: Column, weight: Column | float = 1.0) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-8)), F.lit(1 - 1e-8))
    w = F.lit(weight) if isinstance(weight, float) else weight
    return -w * (y * F.ln(q) + (1 - y) * F.ln(1 - q))


def mask_loss(cells: DataFrame, smooth: float = 1.0) -> DataFrame:
    """One row: loss, the mean cross-entropy of cells (p, g) plus one less the Dice of all cells together."""
    dice = (2 * F.sum(F.col("p") * F.col("g")) + smooth) / (F.sum("p") + F.sum("g") + smooth)
    return cells.agg((F.avg(cross_entropy(F.col("g"), F.col("p"))) + 1 - dice).alias("loss"))


def cosine_rate(step: Column, total: int, warm: int, floor: float) -> Column:
    """Learning-rate factor: linear up to `warm` steps, then half a cosine down to `floor`."""
    done = F.least(F.greatest((step - warm) / F.lit(float(max(1, total - warm))), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warm, (step + 1) / F.lit(float(max(1, warm)))).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(done * F.lit(3.141592653589793))))


def first_match(text: Column, values: list[tuple[str, float]], default: float) -> Column:
    """The value of the first entry whose word is in the text, upper and lower case alike; the default where none is."""
    out = F.lit(default)
    for word, v in reversed(values):
        out = F.when(F.lower(text).contains(word), F.lit(v)).otherwise(out)
    return out
