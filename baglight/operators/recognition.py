"""Recognition and screening metrics over long tables.

Predictions are rows (uid, cls, y, p) with y 0 or 1. Equal scores form one step: rows are first
summed by score and then from the top by ranges of scores (rows.sums_from_top), and a metric that is undefined (no positive
or no negative row) is null, never NaN. Rows with a null score or label don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baglight.operators.rows import sums_from_top

GRID = 49


def _steps(preds: DataFrame, by: list[str], weight: Column | None = None, many: bool = False) -> DataFrame:
    """by, p, tp, n, and the sums over all scores not below p. With many groups (thousands of replicates) the groups themselves spread the work."""
    w = F.lit(1) if weight is None else weight
    step = preds.filter("y is not null and p is not null").groupBy(*by, "p").agg(F.sum(w * F.col("y")).alias("tp"), F.sum(w).alias("n"))
    if many:
        down = Window.partitionBy(*by).orderBy(F.desc("p"))
        return step.withColumn("tp_upto", F.sum("tp").over(down)).withColumn("n_upto", F.sum("n").over(down))
    return sums_from_top(step, by, "p", {"tp_upto": F.col("tp"), "n_upto": F.col("n")})


def average_precision(preds: DataFrame, by: list[str], weight: Column | None = None, many: bool = False) -> DataFrame:
    """by, ap, positives: precision at each score times the step in recall; null without positives or without negatives."""
    s = _steps(preds, by, weight, many)
    agg = s.groupBy(*by).agg(F.sum("tp").alias("positives"), F.sum("n").alias("rows"), F.sum(F.when(F.col("tp") > 0, F.col("tp") * F.col("tp_upto") / F.col("n_upto")).otherwise(0.0)).alias("area"))
    ok = (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    return agg.select(*by, F.when(ok, F.col("area") / F.col("positives")).alias("ap"), "positives")


def auroc(preds: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """by, auroc: share of (positive, negative) pairs in the right order, ties as half; null with one class only."""
    s = _steps(preds, by, weight)
    neg = F.col("n") - F.col("tp")
    # Negatives below a step: all negatives less those at or above it.
    agg = s.groupBy(*by).agg(F.sum("tp").alias("pos"), F.sum(neg).alias("neg"), F.sum(F.col("tp") * ((F.col("n_upto") - F.col("tp_upto")) - neg * 0.5)).alias("above"))
    pairs = F.col("pos") * F.col("neg")
    return agg.select(*by, F.when(pairs > 0, 1 - F.col("above") / pairs).alias("auroc"))


def mean_ap(preds: DataFrame) -> DataFrame:
    return average_precision(preds, ["cls"]).agg(F.avg("ap").alias("map"))


def thresholds(preds: DataFrame, by: tuple[str, ...] = ("cls",)) -> DataFrame:
    """by, thr, f1: the first of GRID thresholds from 0.02 to 0.98 with the best F1; 0.5 without positives.

    A row passes all grid points up to its score, so it is counted once at the last of them and summed from above:
    the grid never multiplies the rows.
    """
    at = F.least(F.floor((F.col("p") - 0.02) / 0.02 + 1e-9), F.lit(GRID - 1))
    # The grid point is compared with the score as the double it is.
    at = F.when(0.02 + (at + 1) * 0.02 <= F.col("p"), F.least(at + 1, F.lit(GRID - 1))).when(0.02 + at * 0.02 > F.col("p"), at - 1).otherwise(at)
    rows = preds.filter("y is not null and p is not null").withColumn("i", F.greatest(at, F.lit(-1)).cast("int"))
    cell = rows.groupBy(*by, "i").agg(F.sum("y").alias("tp"), F.count("*").alias("n"))
    grid = rows.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(-1), F.lit(GRID - 1))).alias("i"))
    up = Window.partitionBy(*by).orderBy(F.desc("i"))
    every = Window.partitionBy(*by)
    swept = grid.join(cell, [*by, "i"], "left").fillna(0).withColumn("pos", F.sum("tp").over(every)).withColumn("tp", F.sum("tp").over(up)).withColumn("n", F.sum("n").over(up)).filter("i >= 0")
    f1 = F.round(2 * F.col("tp") / F.greatest(F.col("n") + F.col("pos"), F.lit(1)), 9)
    best = swept.withColumn("f1", f1).groupBy(*by).agg(F.max(F.struct("f1", -F.col("i"))).alias("b"), F.max("pos").alias("pos"))
    return best.select(*by, F.when(F.col("pos") > 0, F.round(0.02 - F.col("b.col2") * 0.02, 6)).otherwise(0.5).alias("thr"), F.col("b.f1").alias("f1"))


def recall_thresholds(preds: DataFrame, recall: float = 0.95) -> DataFrame:
    """cls, thr: the score that keeps the wanted recall, the k-th smallest of a class's n positives, k = floor((1 - recall) n)."""
    pos = preds.filter("y = 1 and p is not null")
    count = pos.groupBy("cls").agg(F.count("*").alias("n"))
    step = sums_from_top(pos.groupBy("cls", "p").agg(F.count("*").alias("m")), ["cls"], "p", {"from_top": F.col("m")})
    k = F.least(F.floor(F.lit(1 - recall) * F.col("n")), F.col("n") - 1)
    # Those at or below a score are all but those above it.
    return step.join(F.broadcast(count), "cls").filter(F.col("n") - F.col("from_top") + F.col("m") > k).groupBy("cls").agg(F.min("p").alias("thr"))


def f1_report(preds: DataFrame, thr: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (a row of each `by`): macro_f1 over classes with positives, micro_f1, micro_p, micro_r at the classes' thresholds."""
    hit = (F.col("p") >= F.col("thr")).cast("int")
    per = preds.join(F.broadcast(thr.select(*by, "cls", "thr")), [*by, "cls"]).groupBy(*by, "cls").agg(F.sum(hit * F.col("y")).alias("tp"), F.sum(hit).alias("called"), F.sum("y").alias("pos"))
    f1 = 2 * F.col("tp") / F.greatest(F.col("called") + F.col("pos"), F.lit(1))
    tp, called, pos = F.sum("tp"), F.sum("called"), F.sum("pos")
    return per.groupBy(*by).agg(
        F.avg(F.when(F.col("pos") > 0, f1)).alias("macro_f1"),
        (2 * tp / F.greatest(called + pos, F.lit(1))).alias("micro_f1"),
        (tp / F.greatest(called, F.lit(1))).alias("micro_p"),
        (tp / F.greatest(pos, F.lit(1))).alias("micro_r"),
    )


def bag_scores(preds: DataFrame) -> DataFrame:
    """uid, score: the highest score over the classes."""
    return preds.groupBy("uid").agg(F.max("p").alias("score"))


def roc(screening: DataFrame) -> DataFrame:
    """score, fpr, tpr at every distinct score of screening (threat, score), from the top."""
    s = _steps(screening.select(F.lit(0).alias("g"), F.col("threat").alias("y"), F.col("score").alias("p")), ["g"])
    all_ = screening.filter("score is not null").agg(F.sum("threat").alias("pos"), F.sum(1 - F.col("threat")).alias("neg"))
    return s.crossJoin(F.broadcast(all_)).select(F.col("p").alias("score"), F.expr("try_divide(n_upto - tp_upto, neg)").alias("fpr"), F.expr("try_divide(tp_upto, pos)").alias("tpr"))


def _kth_positive(screening: DataFrame, recall: float) -> DataFrame:
    """One row: cut, the k-th smallest positive score."""
    return recall_thresholds(screening.select(F.lit(0).alias("cls"), F.col("threat").alias("y"), F.col("score").alias("p")), recall).select(F.col("thr").alias("cut"))


def bag_report(screening: DataFrame, fprs: tuple[float, ...] = (0.05, 0.01), recalls: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """One row: n_threat, n_clean, auroc, tpr_at_fpr_* by interpolation on the ROC, clear_at_rec_*, the share of clean scores strictly below the cut.

    With one class only, everything but the counts is null.
    """
    out = screening.agg(F.sum("threat").alias("n_threat"), F.sum(1 - F.col("threat")).alias("n_clean"))
    both = (F.col("n_threat") > 0) & (F.col("n_clean") > 0)
    area = auroc(screening.select(F.lit(0).alias("g"), F.col("threat").alias("y"), F.col("score").alias("p")), ["g"]).select("auroc")
    out = out.join(area)
    points = roc(screening).select("fpr", "tpr").union(screening.sparkSession.createDataFrame([(0.0, 0.0)], "fpr double, tpr double"))
    right = points.groupBy("fpr").agg(F.max("tpr").alias("tpr"), F.min("tpr").alias("low"))
    for f in fprs:
        # The right-most point at or before f, and the lowest point after it.
        before = right.filter(F.col("fpr") <= f).agg(F.max(F.struct("fpr", "tpr")).alias("b"))
        after = right.filter(F.col("fpr") > f).agg(F.min(F.struct("fpr", "low")).alias("a"))
        step = (F.lit(f) - F.col("b.fpr")) / (F.col("a.fpr") - F.col("b.fpr"))
        tpr = F.when(F.col("a").isNull(), F.col("b.tpr")).otherwise(F.col("b.tpr") + step * (F.col("a.low") - F.col("b.tpr")))
        out = out.join(before.join(after).select(tpr.alias(f"tpr_at_fpr_{round(f * 100)}")))
    for r in recalls:
        cut = _kth_positive(screening, r)
        clear = screening.join(F.broadcast(cut)).filter("threat = 0").agg(F.avg((F.col("score") < F.col("cut")).cast("double")).alias(f"clear_at_rec_{round(r * 100)}"))
        out = out.join(clear)
    rest = [c for c in out.columns if c not in ("n_threat", "n_clean")]
    return out.select("n_threat", "n_clean", *[F.when(both, F.col(c)).alias(c) for c in rest])


def recall_clearance(screening: DataFrame, points: int = 20) -> DataFrame:
    """thr, recall (positives at or above), clearance (negatives below) at quantiles of the positive scores."""
    q = screening.filter("threat = 1").agg(F.percentile("score", F.array(*[F.lit(i / points) for i in range(points + 1)])).alias("q"))
    thr = q.select(F.explode(F.array_distinct("q")).alias("thr"))
    return screening.join(F.broadcast(thr)).groupBy("thr").agg(
        F.avg(F.when(F.col("threat") == 1, (F.col("score") >= F.col("thr")).cast("double"))).alias("recall"),
        F.avg(F.when(F.col("threat") == 0, (F.col("score") < F.col("thr")).cast("double"))).alias("clearance"),
    )


def confusion(preds: DataFrame) -> DataFrame:
    """actual, called, n over rows with exactly one label; the called class is the first of the highest scores."""
    per = preds.groupBy("uid").agg(F.sum("y").alias("labels"), F.max(F.when(F.col("y") == 1, F.col("cls"))).alias("actual"), F.max(F.struct("p", -F.col("cls"))).alias("top"))
    return per.filter("labels = 1").groupBy("actual", (-F.col("top.col2")).cast("int").alias("called")).agg(F.count("*").alias("n"))


def confusion_shares(conf: DataFrame) -> DataFrame:
    """Adds share: the part of the actual class's rows."""
    return conf.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("actual")), F.lit(1)))


def lookalikes(conf: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, scans, correct, confused_within of classes (cls, grp) that look alike."""
    g = F.broadcast(groups)
    both = conf.join(g.toDF("actual", "grp"), "actual").join(g.toDF("called", "called_grp"), "called", "left")
    same = F.col("actual") == F.col("called")
    return both.groupBy("grp").agg(F.sum("n").alias("scans"), F.sum(F.when(same, F.col("n")).otherwise(0)).alias("correct"), F.sum(F.when(~same & (F.col("grp") == F.col("called_grp")), F.col("n")).otherwise(0)).alias("confused_within"))


def terciles(rows: DataFrame, value: str) -> DataFrame:
    """One row: lo, hi, the linear 1/3 and 2/3 quantiles of finite values; null with fewer than three."""
    v = F.col(value)
    q = rows.filter(v.isNotNull() & ~F.isnan(v.cast("double"))).agg(F.percentile(v, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"), F.count("*").alias("n"))
    return q.select(F.when(F.col("n") >= 3, F.col("q")[0]).alias("lo"), F.when(F.col("n") >= 3, F.col("q")[1]).alias("hi"))


def pair_strata(values: DataFrame, edges: DataFrame) -> DataFrame:
    """uid, cls, stratum: edges at or below the largest value of a pair's boxes (0, 1, 2)."""
    top = values.groupBy("uid", "cls").agg(F.max("value").alias("value"))
    return top.join(F.broadcast(edges)).select("uid", "cls", ((F.col("value") >= F.col("lo")).cast("int") + (F.col("value") >= F.col("hi")).cast("int")).alias("stratum"))


def stratified_ap(preds: DataFrame, strata: DataFrame, least: int = 3) -> DataFrame:
    """stratum, map, positives, classes: per stratum its positives against all negatives; classes with fewer than `least` are left out.

    Negatives are copied to the strata (three), positives stay in their own.
    """
    s = preds.join(strata, ["uid", "cls"], "left")
    all_ = F.broadcast(strata.select(F.col("stratum").alias("at")).distinct())
    pos = s.filter("y = 1 and stratum is not null").select(F.col("stratum").alias("at"), "cls", "y", "p")
    neg = s.filter("y = 0").join(all_).select("at", "cls", "y", "p")
    per = average_precision(pos.unionByName(neg), ["at", "cls"]).filter(F.col("positives") >= least)
    return per.groupBy(F.col("at").alias("stratum")).agg(F.avg("ap").alias("map"), F.sum("positives").alias("positives"), F.count("*").alias("classes"))
