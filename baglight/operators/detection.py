"""Localisation metrics over long box tables.

Ground truth is (uid, k, cls, x1, y1, x2, y2), detections also have score; (uid, k) is unique in
each. All joins are on uid, so a scan's boxes meet in one task and no others do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baglight.functions import geometry as G
from baglight.operators.rows import greatest_below, sums_from_top


def iou_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """uid, ka, kb, iou of boxes of one scan that overlap enough."""
    value = G.iou(G.box("a"), G.box("b"))
    return a.alias("a").join(b.alias("b"), "uid").select("uid", F.col("a.k").alias("ka"), F.col("b.k").alias("kb"), value.alias("iou")).filter(F.col("iou") >= least)


def matched(det: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """Detections (uid, k, cls, score) with tp: a detection is compared with its best box of the class only, and the first by score keeps the box."""
    best = det.alias("a").join(gt.alias("b"), (F.col("a.uid") == F.col("b.uid")) & (F.col("a.cls") == F.col("b.cls")), "left")
    top = best.groupBy("a.uid", "a.k", "a.cls", "a.score").agg(F.max(F.struct(F.coalesce(G.iou(G.box("a"), G.box("b")), F.lit(-1.0)).alias("iou"), (-F.col("b.k")).alias("nk"))).alias("m"))
    top = top.select("uid", "k", "cls", "score", F.when(F.col("m.iou") >= least, -F.col("m.nk")).alias("of"))
    first = F.row_number().over(Window.partitionBy("uid", "cls", "of").orderBy(F.desc("score"), "k"))
    return top.withColumn("tp", (F.col("of").isNotNull() & (first == 1)).cast("int"))


def box_ap(det: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """cls, ap, boxes: area under the precision envelope; 0 with boxes but no detections. Classes without boxes are left out.

    Precision and recall are summed over detections by score, then scan, then number, which makes
    the order total.
    """
    total = gt.groupBy("cls").agg(F.count("*").alias("boxes"))
    then = (F.col("uid"), F.col("k"))
    d = matched(det, gt, least).join(F.broadcast(total), "cls")
    d = sums_from_top(d, ["cls"], "score", {"hit": F.col("tp"), "n": F.lit(1)}, then).withColumn("precision", F.col("hit") / F.col("n"))
    per = greatest_below(d, ["cls"], "score", "precision", "envelope", then).groupBy("cls").agg(F.sum(F.col("tp") * F.col("envelope") / F.col("boxes")).alias("ap"))
    return total.join(per, "cls", "left").select("cls", F.coalesce("ap", F.lit(0.0)).alias("ap"), "boxes")


def proposal_recall(props: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: boxes, recall_iou (some proposal with IoU enough), recall_any (or that covers enough of the box)."""
    pair = gt.alias("a").join(props.alias("b"), F.col("a.uid") == F.col("b.uid"), "left")
    per = pair.groupBy("a.uid", "a.k").agg(F.max(G.iou(G.box("a"), G.box("b"))).alias("iou"), F.max(G.ioa(G.box("a"), G.box("b"))).alias("ioa"))
    hit = F.coalesce(F.col("iou") >= least, F.lit(False))
    any_ = hit | F.coalesce(F.col("ioa") >= least, F.lit(False))
    return per.agg(F.count("*").alias("boxes"), F.avg(hit.cast("double")).alias("recall_iou"), F.avg(any_.cast("double")).alias("recall_any"))


def pointing_game(peaks: DataFrame, gt: DataFrame, slack: float = 15.0) -> DataFrame:
    """cls, pairs, accuracy: is the peak (uid, cls, x, y) in some box of its class, give or take the slack."""
    inside = (F.col("x") >= F.col("x1") - slack) & (F.col("x") <= F.col("x2") + slack) & (F.col("y") >= F.col("y1") - slack) & (F.col("y") <= F.col("y2") + slack)
    per = gt.join(peaks, ["uid", "cls"]).groupBy("uid", "cls").agg(F.max(inside.cast("int")).alias("hit"))
    return per.groupBy("cls").agg(F.count("*").alias("pairs"), F.avg("hit").alias("accuracy"))


def proposal_sweep(props: DataFrame, gt: DataFrame, scans: DataFrame, grid: list[float], most: float) -> DataFrame:
    """thr, recall, per_scan, best: box recall and proposals a scan at each threshold; best marks the highest recall under `most`, ties to the larger threshold.

    scans (uid, one row each) are all of the part, those without any box too: on them every proposal is a false alarm.
    If no threshold keeps below `most`, the highest recall of all is marked.

    Every box's best proposal score among those that cover it decides the recall at all thresholds, so the grid isn't joined with the pairs.
    """
    scans = scans.count()
    pair = gt.alias("a").join(props.alias("b"), F.col("a.uid") == F.col("b.uid"), "left")
    covers = (G.iou(G.box("a"), G.box("b")) >= 0.5) | (G.ioa(G.box("a"), G.box("b")) >= 0.5)
    box = pair.groupBy("a.uid", "a.k").agg(F.max(F.when(covers, F.col("b.score"))).alias("score"))
    flags = lambda c: [F.sum((F.col(c) >= t).cast("int")).alias(f"n{i}") for i, t in enumerate(grid)]
    kept = box.agg(F.count("*").alias("n"), *flags("score"))
    made = props.agg(*flags("score"))
    to_rows = lambda df, *more: df.select(*more, F.posexplode(F.array(*[f"n{i}" for i in range(len(grid))])).alias("i", "v"))
    r = to_rows(kept, "n").join(to_rows(made).withColumnRenamed("v", "made"), "i")
    r = r.select(F.element_at(F.lit(grid), F.col("i") + 1).alias("thr"), (F.coalesce("v", F.lit(0)) / F.col("n")).alias("recall"), (F.col("made") / scans).alias("per_scan"))
    ok = F.col("per_scan") <= most
    rank = F.row_number().over(Window.orderBy(ok.desc(), F.desc("recall"), F.desc("thr")))  # one row a threshold
    return r.withColumn("best", rank == 1)


def seg_report(cells: DataFrame, thr: float = 0.5) -> DataFrame:
    """One row: dice and iou (mean over scans with a true mask) and fp_rate (share of called cells on scans without), of cells (uid, v, g)."""
    p, g = (F.col("v") >= thr).cast("int"), (F.col("g") > 0).cast("int")
    per = cells.groupBy("uid").agg(F.sum(p * g).alias("both"), F.sum(p).alias("p"), F.sum(g).alias("g"), F.count("*").alias("n"))
    real = F.col("g") > 0
    return per.agg(
        F.avg(F.when(real, 2 * F.col("both") / (F.col("p") + F.col("g")))).alias("dice"),
        F.avg(F.when(real, F.col("both") / (F.col("p") + F.col("g") - F.col("both")))).alias("iou"),
        (F.sum(F.when(~real, F.col("p"))) / F.sum(F.when(~real, F.col("n")))).alias("fp_rate"),
    )


def top_boxes(props: DataFrame, scores: DataFrame, classes: int = 3, least: float = 0.02) -> DataFrame:
    """uid, k, cls, score: each proposal (uid, k, peak) with the scan's best classes (uid, cls, p), scored p times peak."""
    best = Window.partitionBy("uid").orderBy(F.desc("p"), "cls")
    top = scores.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= classes)
    return props.join(top, "uid").select("uid", "k", "cls", (F.col("p") * F.col("peak")).alias("score")).filter(F.col("score") >= least)


def crop_boxes(crops: DataFrame, scans: DataFrame | None = None, mix: float = 0.0, classes: int = 3, least: float = 0.02) -> DataFrame:
    """uid, k, cls, score: each proposal with the best classes of its own crop (uid, k, cls, p); with mix, that share of the score is the scan's (uid, cls, p), where it has one."""
    s = F.col("p")
    if mix > 0 and scans is not None:
        crops = crops.join(scans.select("uid", "cls", F.col("p").alias("of_scan")), ["uid", "cls"], "left")
        s = F.coalesce((1 - mix) * s + mix * F.col("of_scan"), s)
    best = Window.partitionBy("uid", "k").orderBy(F.desc("score"), "cls")
    top = crops.select("uid", "k", "cls", s.alias("score")).withColumn("n", F.row_number().over(best))
    return top.filter((F.col("n") <= classes) & (F.col("score") >= least)).drop("n")


def placed(props: DataFrame, scans: DataFrame, least: float = 2.0) -> DataFrame:
    """Proposals (uid, k, peak, x1, y1, x2, y2 in the letterbox) in their pictures (uid, scale, pad_x, pad_y, img_w, img_h), cut off at the edges; a side under `least` pixels drops the proposal."""
    x1, y1, x2, y2 = G.from_cache(G.box(), *[F.col(c) for c in ("scale", "pad_x", "pad_y", "img_w", "img_h")])
    at = props.join(scans, "uid").select("uid", "k", "peak", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return at.filter((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))
