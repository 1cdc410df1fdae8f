"""Patch tables for the zoom stage: squares around boxes, boxes in patch coordinates, labels of crops.

A patch is a row (uid, kind, k, score, rx1, ry1, rx2, ry2): kind is pos (a true box), rand
(background), hard (a false alarm) or prop (a proposal to be judged), k its number in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baglight.functions import geometry as G
from baglight.operators.patches import hard_negatives

#: Side of a stored patch, how much wider than its box it is, and the least side of a box taken for it.
SIDE, WIDER, LEAST = 320.0, 2.0, 48.0
REGION = ("rx1", "ry1", "rx2", "ry2")


def _patches(boxes: DataFrame, kind: str, score: Column) -> DataFrame:
    r = G.square_region(G.box(), WIDER, LEAST * WIDER)
    cut = boxes.select("uid", F.lit(kind).alias("kind"), "k", score.cast("double").alias("score"), r.alias("r"))
    return cut.select("uid", "kind", "k", "score", *[F.col(f"r.{c[1:]}").alias(c) for c in REGION])


def train_patches(gt: DataFrame, background: DataFrame, props: DataFrame, hard: int = 3) -> DataFrame:
    """Patches to learn from: every true box, background boxes, and the first proposals (uid, k, box, score) of a scan that lie on no true box."""
    found = hard_negatives(props, gt, hard)
    return _patches(gt, "pos", F.lit(1.0)).unionByName(_patches(background, "rand", F.lit(0.0))).unionByName(_patches(found, "hard", F.col("score")))


def eval_patches(props: DataFrame) -> DataFrame:
    """A patch for each proposal; of true boxes with score 1 these are the patches of a perfect first stage."""
    return _patches(props, "prop", F.col("score"))


def patch_boxes(patches: DataFrame, gt: DataFrame, side: float = SIDE) -> DataFrame:
    """uid, kind, k, b, cls, x1, y1, x2, y2: true boxes (b: their k) in the coordinates of each patch of their scan; boxes outside it are left out."""
    scale = F.lit(side) / (F.col("rx2") - F.col("rx1"))
    j = patches.join(gt.withColumnRenamed("k", "b"), "uid")
    to = lambda c, at: ((F.col(c) - F.col(at)) * scale).alias(c)
    moved = j.select("uid", "kind", "k", "b", "cls", to("x1", "rx1"), to("y1", "ry1"), to("x2", "rx1"), to("y2", "ry1"))
    return moved.filter((F.col("x2") > 0) & (F.col("y2") > 0) & (F.col("x1") < side) & (F.col("y1") < side))


def crop_labels(boxes: DataFrame, context: float = 1.3, excluded: tuple[int, ...] = (), side: float = SIDE, least: float = 0.5) -> DataFrame:
    """uid, kind, k, cls: the classes with at least half of a box of patch_boxes inside the middle square of a patch, `context` times as wide as the patch's own box."""
    half = context * side / WIDER / 2
    region = tuple(F.lit(side / 2 + s * half) for s in (-1, -1, 1, 1))
    inside = boxes.filter((G.ioa(G.box(), region) >= least) & (F.col("cls") >= 0) & ~F.col("cls").isin(*excluded))
    return inside.select("uid", "kind", "k", "cls").distinct()


def kind_counts(patches: DataFrame, by: str) -> DataFrame:
    """by, pos, rand, hard, prop: patches of each kind."""
    of = lambda kind: F.sum((F.col("kind") == kind).cast("int")).alias(kind)
    return patches.groupBy(by).agg(*[of(k) for k in ("pos", "rand", "hard", "prop")])


def classes_per_patch(labels: DataFrame) -> DataFrame:
    """classes, patches: how many patches have so many classes, of labels as crop_labels gives them."""
    return labels.groupBy("uid", "kind", "k").agg(F.countDistinct("cls").alias("classes")).groupBy("classes").agg(F.count("*").alias("patches"))


def box_scores(det: DataFrame) -> DataFrame:
    """uid, cls, p: the highest score of a detector's boxes of a class in a scan."""
    return det.groupBy("uid", "cls").agg(F.max("score").alias("p"))


def placement(cells: DataFrame, concealed: bool = True) -> DataFrame:
    """uid, r, c, p of cells (uid, r, c, v, g): the probability of placing an object there, by the square of the clutter v within the bag g, or by the bag alone; uniform where that is nothing."""
    w = F.pow(F.greatest(F.col("v"), F.lit(0.0)), 2) * F.col("g") if concealed else F.col("g").cast("double")
    total = cells.withColumn("w", w).groupBy("uid").agg(F.sum("w").alias("total"), F.count("*").alias("n"))
    p = F.when(F.col("total") <= 1e-6, 1.0 / F.col("n")).otherwise(w / F.col("total"))
    return cells.join(total, "uid").select("uid", "r", "c", p.alias("p"))


def box_cells(boxes: DataFrame, h: int, w: int) -> DataFrame:
    """uid, r, c: the cells of an h x w grid that some box of the scan covers; ends are rounded half to even and cut off at the grid."""
    end = lambda c, most: F.least(F.greatest(F.bround(c).cast("int"), F.lit(0)), F.lit(most))
    b = boxes.select("uid", end("y1", h).alias("a"), end("y2", h).alias("z"), end("x1", w).alias("l"), end("x2", w).alias("m")).filter("a < z and l < m")
    rows = b.select("uid", "l", "m", F.explode(F.sequence("a", F.col("z") - 1)).alias("r"))
    return rows.select("uid", "r", F.explode(F.sequence("l", F.col("m") - 1)).alias("c")).distinct()


def mask_agreement(cells: DataFrame, boxes: DataFrame, h: int, w: int) -> DataFrame:
    """uid, agree: the share of a scan's mask (uid, r, c, g) that lies in its boxes, each a cell wider on all sides; null without mask."""
    wide = boxes.select("uid", *[F.greatest(F.floor(c) - 1, F.lit(0)).alias(c) for c in ("x1", "y1")], *[(F.ceil(c) + 1).alias(c) for c in ("x2", "y2")])
    inside = box_cells(wide, h, w).withColumn("inside", F.lit(1))
    j = cells.join(inside, ["uid", "r", "c"], "left")
    return j.groupBy("uid").agg(F.expr("try_divide(sum(g * coalesce(inside, 0)), sum(g))").alias("agree"))


def agreement(rows: DataFrame, column: str, low: float = 0.5) -> DataFrame:
    """One row: n, median, share below `low` of the values that aren't null."""
    v = F.col(column)
    return rows.filter(v.isNotNull()).agg(F.count("*").alias("n"), F.median(v).alias("median"), F.avg((v < low).cast("double")).alias("share_low"))


def foreground(cells: DataFrame, apart: float) -> DataFrame:
    """uid, r, c, g: 1 where a cell's value is more than `apart` from the most frequent value of its picture (the least of equals), else 0."""
    often = cells.groupBy("uid", "v").agg(F.count("*").alias("n")).groupBy("uid").agg(F.max(F.struct("n", (-F.col("v")).alias("v"))).alias("m"))
    return cells.join(often, "uid").select("uid", "r", "c", (F.abs(F.col("v") + F.col("m.v")) > apart).cast("int").alias("g"))
