"""Choosing boxes and patches: donors, background, hard negatives, capped samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baglight.functions import geometry as G


def hashed(seed: int, *key: str) -> Column:
    """A random order of keys that any engine can follow."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))


def capped(rows: DataFrame, by: list[str], most: int, *key: str, seed: int = 0) -> DataFrame:
    """At most `most` rows of each group, the first by a hash of the key: the same whatever the partitions, cut before the shuffle."""
    order = [hashed(seed, *key), *key]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def donors(boxes: DataFrame, most: int = 1500, apart: float = 0.3, seed: int = 0) -> DataFrame:
    """Boxes (uid, k, cls, ...) that no other box of their scan covers by more than `apart`, at most `most` a class."""
    other = boxes.select("uid", F.col("k").alias("k2"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    them = tuple(F.col(f"o{c}") for c in ("x1", "y1", "x2", "y2"))
    crowded = boxes.join(other, "uid").filter((F.col("k") != F.col("k2")) & (G.ioa(G.box(), them) > apart)).select("uid", "k").distinct()
    return capped(boxes.join(crowded, ["uid", "k"], "left_anti"), ["cls"], most, "uid", "k", seed=seed)


def hard_negatives(props: DataFrame, gt: DataFrame, most: int = 3, apart: float = 0.1, either: bool = False) -> DataFrame:
    """The first proposals (uid, k, ...) of each scan with at most `apart` of their area in any true box; with either, also at most that share of a true box in them."""
    a, b = G.box(), tuple(F.col(f"g{c}") for c in ("x1", "y1", "x2", "y2"))
    truth = gt.select("uid", *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])
    near = props.join(truth, "uid").filter((G.ioa(a, b) > apart) | ((G.ioa(b, a) > apart) if either else F.lit(False))).select("uid", "k").distinct()
    free = props.join(near, ["uid", "k"], "left_anti")
    return free.withColumn("__n", F.row_number().over(Window.partitionBy("uid").orderBy("k"))).filter(F.col("__n") <= most).drop("__n")


def background_boxes(scans: DataFrame, gt: DataFrame, n: int, sides: list[float], tries: int = 30, apart: float = 0.1, seed: int = 0) -> DataFrame:
    """uid, k, box: up to n squares of scans (uid, w, h) away from true boxes: of tries * n places drawn by a hash, the first that fit."""
    from baglight.operators.bootstrap import uniform

    k = F.col("k")
    draw = scans.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tries * n - 1))))
    side = F.least(F.element_at(F.lit([float(s) for s in sides]), (F.floor(uniform(seed, F.col("uid"), k, F.lit("s")) * len(sides)) + 1).cast("int")), F.col("w"), F.col("h"))

    def place(axis: str, length: Column) -> Column:
        return F.floor(uniform(seed, F.col("uid"), k, F.lit(axis)) * (length - F.col("side")))

    made = draw.withColumn("side", side).withColumn("x1", place("x", F.col("w"))).withColumn("y1", place("y", F.col("h")))
    made = made.select("uid", "k", F.col("x1").cast("double").alias("x1"), F.col("y1").cast("double").alias("y1"), (F.col("x1") + F.col("side")).alias("x2"), (F.col("y1") + F.col("side")).alias("y2"))
    return hard_negatives(made, gt, n, apart, either=True)
