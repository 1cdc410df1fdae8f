"""Whole evaluations: what is tuned is tuned on one part and used on another.

val and test are tables of predictions (uid, cls, y, p), or of fused scores. Nothing of test enters
a threshold, a blend or an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baglight.operators import anomaly, recognition as R, splits
from baglight.operators.cascade import tune_alpha

RULES = ("s1", "s2", "blend", "max")


def evaluate_scores(val: DataFrame, test: DataFrame) -> DataFrame:
    """One row: val_map, map, macro_f1, micro_f1 on test at thresholds of val, and the screening of test scans by their highest score."""
    threat = test.groupBy("uid").agg(F.max("y").alias("threat"), F.max("p").alias("score"))
    f1 = R.f1_report(test, R.thresholds(val)).select("macro_f1", "micro_f1")
    bags = R.bag_report(threat).select(*[F.col(c).alias(f"bag_{c}") for c in ("n_threat", "n_clean", "auroc", "tpr_at_fpr_5", "clear_at_rec_95")])
    return R.mean_ap(val).withColumnRenamed("map", "val_map").join(R.mean_ap(test)).join(f1).join(bags)  # one row each


def evaluate_cascade(val: DataFrame, test: DataFrame) -> DataFrame:
    """rule, alpha, map, macro_f1 of fused scores (uid, cls, y, s1, s2, has): alpha and thresholds of val on test; alpha is null but for the blend.

    Scans without crops keep their own score under blend and max and have none under s2.
    """
    alpha = tune_alpha(val).filter("best").select(F.col("alpha"))  # one row

    def by_rule(rows: DataFrame) -> DataFrame:
        s1, s2 = F.col("s1"), F.when(F.col("has"), F.col("s2")).otherwise(0.0)
        keep = lambda c: F.when(F.col("has"), c).otherwise(s1)
        scores = {"s1": s1, "s2": s2, "blend": keep(F.round(F.col("alpha") * s1 + (1 - F.col("alpha")) * s2, 9)), "max": keep(F.greatest(s1, s2))}
        each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), scores[r].alias("p")) for r in RULES])).alias("x")
        return rows.join(F.broadcast(alpha)).select("uid", "cls", "y", each).select("uid", "cls", "y", "x.rule", "x.p")

    tuned, used = R.thresholds(by_rule(val), ("rule", "cls")), by_rule(test)
    maps = R.average_precision(used, ["rule", "cls"]).groupBy("rule").agg(F.avg("ap").alias("map"))
    f1 = R.f1_report(used, tuned, ("rule",)).select("rule", "macro_f1")
    return maps.join(f1, "rule").join(F.broadcast(alpha)).select("rule", F.when(F.col("rule") == "blend", F.col("alpha")).alias("alpha"), "map", "macro_f1")


def stratified_report(preds: DataFrame, strata: DataFrame, thr: DataFrame, least: int = 3) -> DataFrame:
    """stratum, map, recall, positives: means over the classes with at least `least` positives in a stratum; recall at the classes' thresholds."""
    ap = R.stratified_ap(preds, strata, least).select("stratum", "map", "positives")
    pos = preds.filter("y = 1").join(strata, ["uid", "cls"]).join(F.broadcast(thr.select("cls", "thr")), "cls")
    per = pos.groupBy("stratum", "cls").agg(F.count("*").alias("n"), F.avg((F.col("p") >= F.col("thr")).cast("double")).alias("recall")).filter(F.col("n") >= least)
    return ap.join(per.groupBy("stratum").agg(F.avg("recall").alias("recall")), "stratum", "left").select("stratum", "map", "recall", "positives")


def evaluate_bank(val: DataFrame, test: DataFrame, top: int = 10) -> DataFrame:
    """One row: n_null, centre, spread, auroc_max, auroc_top, tpr5_max, tpr5_top, pixel_auroc of anomaly maps (uid, r, c, v, g; g: true cell).

    The null distribution are the highest values of val's clean scans and those outside the true cells
    of its other scans. Scans are screened by their highest value and by the mean of their `top` highest;
    cells are judged on test scans with a true cell.
    """
    threat = lambda cells: cells.groupBy("uid").agg(F.max("g").alias("threat"), F.max("v").alias("most"))
    t = threat(val)
    clean = t.filter("threat = 0").select(F.col("most").alias("x"))
    around = anomaly.masked_max(val).join(t.filter("threat = 1").select("uid"), "uid").select(F.col("score").alias("x"))
    null = clean.union(around)
    fit = anomaly.robust_fit(null, "x").join(null.agg(F.count("x").alias("n_null")))
    scores = anomaly.top_mean(test, top).join(threat(test).select("uid", "threat"), "uid")

    def bags(column: str, name: str) -> DataFrame:
        return R.bag_report(scores.select("threat", F.col(column).alias("score"))).select(F.col("auroc").alias(f"auroc_{name}"), F.col("tpr_at_fpr_5").alias(f"tpr5_{name}"))

    on = test.join(threat(test).filter("threat = 1").select("uid"), "uid")
    pixel = R.auroc(on.select(F.lit(0).alias("k"), F.col("g").alias("y"), F.col("v").alias("p")), ["k"]).select(F.col("auroc").alias("pixel_auroc"))
    return fit.join(bags("score_max", "max")).join(bags("score_top", "top")).join(pixel)  # one row each


def upsampled(values: Column, h: int, w: int, to_h: int, to_w: int) -> Column:
    """A map of h x w numbers by row, laid out on to_h x to_w cells: linear between the centres of cells, constant beyond the outer ones."""

    def line(n: int, m: int) -> list[tuple[int, int, float]]:
        at = [min(max((i + 0.5) * n / m - 0.5, 0.0), n - 1.0) for i in range(m)]
        return [(int(x), min(int(x) + 1, n - 1), x - int(x)) for x in at]

    rows, cols = line(h, to_h), line(w, to_w)
    corners: list[list] = [[], [], [], []]
    for r0, r1, fr in rows:
        for c0, c1, fc in cols:
            for at, (r, c, share) in zip(corners, [(r0, c0, (1 - fr) * (1 - fc)), (r0, c1, (1 - fr) * fc), (r1, c0, fr * (1 - fc)), (r1, c1, fr * fc)], strict=True):
                at.append((r * w + c, share))
    # Places and shares are literals of the size of the map; the expression stays small.
    part = lambda i, x: F.get(values, F.get(F.lit([p for p, _ in x]), i)) * F.get(F.lit([q for _, q in x]), i)
    return F.transform(F.sequence(F.lit(0), F.lit(to_h * to_w - 1)), lambda i: sum((part(i, x) for x in corners[1:]), part(i, corners[0])))


def prepare_split(scans: DataFrame, fraction: float = 0.15, most: int = 12) -> DataFrame:
    """uid, part, dup_group, near_dup_of_train of scans (uid, split, cache_ok, labels, sig_d, sig_a).

    Cached training scans are grouped by near-duplicates, with the limit lowered until no group is too
    large, and groups are dealt to train and val; at that limit, cached test scans are looked up among
    all of these. Scans that aren't cached stay in their split; without a group dup_group is null.
    """
    ok = F.coalesce("cache_ok", F.lit(False))
    train, test = scans.filter((F.col("split") == "train") & ok), scans.filter((F.col("split") == "test") & ok)
    sigs = splits.signatures(train)
    groups, bits = splits.duplicate_groups(sigs, most)
    named = train.select("uid", "labels").join(groups, "uid", "left").withColumn("group", F.coalesce("group", "uid"))
    sides = splits.grouped_split(named, fraction).join(groups, "uid", "left")
    near = splits.leakage(splits.signatures(test), sigs, bits).select("uid", F.lit(True).alias("near"))
    joined = scans.select("uid", "split").join(sides, "uid", "left").join(near, "uid", "left")
    return joined.select("uid", F.coalesce("side", "split").alias("part"), F.col("group").alias("dup_group"), F.coalesce("near", F.lit(False)).alias("near_dup_of_train"))


def caption_strata(scans: DataFrame, level: Column, least: float = 0.3) -> DataFrame:
    """uid, level of the scans whose caption gives one; no row if it is so in at most `least` of all scans."""
    rows = scans.select("uid", level.alias("level"))
    share = rows.agg(F.avg((F.col("level") >= 0).cast("double")).alias("share"))
    return rows.join(F.broadcast(share)).filter((F.col("share") > least) & (F.col("level") >= 0)).select("uid", "level")


def issue_counts(scans: DataFrame) -> DataFrame:
    """issue, n: scans with each issue of a list parted by semicolons or commas; null and empty lists have none."""
    each = F.explode(F.split("issues", "[;,]")).alias("issue")
    long = scans.filter("issues <> ''").select("uid", each).select("uid", F.trim("issue").alias("issue"))
    return long.filter("issue <> ''").distinct().groupBy("issue").agg(F.count("*").alias("n"))


def progress(states: DataFrame, estimates: DataFrame, optional: Column) -> DataFrame:
    """One row: runs, done, left (minutes of those not done), core_left (without the optional) of states (name, state) and estimates (name, minutes)."""
    j = states.join(estimates, "name").withColumn("open", F.when(F.col("state") != "done", F.col("minutes")).otherwise(0))
    return j.agg(F.count("*").alias("runs"), F.sum((F.col("state") == "done").cast("int")).alias("done"), F.sum("open").alias("left"), F.sum(F.when(optional, 0).otherwise(F.col("open"))).alias("core_left"))
