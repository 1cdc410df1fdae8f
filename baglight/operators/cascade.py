"""Crop scores, their fusion with scan scores, and populations of an open-set test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baglight.operators.recognition import average_precision, auroc, bag_report


def crop_scores(crops: DataFrame, first: int) -> DataFrame:
    """uid, cls, p2: the highest score of a class over a scan's first crops (uid, k, cls, p), k from 0."""
    return crops.filter(F.col("k") < first).groupBy("uid", "cls").agg(F.max("p").alias("p2"))


def fuse(preds: DataFrame, crops: DataFrame, alpha: float | Column = 0.5) -> DataFrame:
    """uid, cls, y and the fused scores s1, s2, max, blend. Without crops, a scan keeps its own score, and s2 is 0."""
    has = crops.select("uid").distinct().withColumn("has", F.lit(True))
    j = preds.join(crops, ["uid", "cls"], "left").join(has, "uid", "left")
    p1, p2 = F.col("p"), F.coalesce("p2", F.lit(0.0))
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    keep = lambda c: F.when(F.col("has"), c).otherwise(p1)
    return j.select("uid", "cls", "y", p1.alias("s1"), p2.alias("s2"), keep(F.greatest(p1, p2)).alias("max"), keep(a * p1 + (1 - a) * p2).alias("blend"), F.coalesce("has", F.lit(False)).alias("has"))


def tune_alpha(fused: DataFrame, steps: int = 10) -> DataFrame:
    """alpha, map, best: mean AP of the blend for alpha = 0, 0.1, ..., 1; the first of the best is marked. A row becomes steps + 1 and is summed by score at once."""
    a = F.col("i") / F.lit(float(steps))
    grid = fused.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    p = F.when(F.col("has"), F.round(a * F.col("s1") + (1 - a) * F.col("s2"), 9)).otherwise(F.col("s1"))
    per = average_precision(grid.select("i", "cls", "y", p.alias("p")), ["i", "cls"]).groupBy("i").agg(F.round(F.avg("ap"), 9).alias("map"))
    best = per.agg(F.max(F.struct("map", -F.col("i"))).alias("b")).select((-F.col("b.col2")).alias("best_i"))
    return per.join(F.broadcast(best)).select(a.alias("alpha"), "map", (F.col("i") == F.col("best_i")).alias("best"))


def population(labels: Column, held_out: list[int]) -> Column:
    """'unknown' (labels all held out), 'known' (none of them), 'benign' (no label), null for mixed ones and null labels; null ids are ignored."""
    labels = F.array_compact(labels)
    held = F.array(*[F.lit(h) for h in held_out]).cast("array<int>")
    return F.when(F.size(labels) == 0, "benign").when(F.size(F.array_except(labels, held)) == 0, "unknown").when(~F.arrays_overlap(labels, held), "known")


def open_set_report(rows: DataFrame) -> DataFrame:
    """population, score, n, auroc against benign of rows (uid, population, and one column a score)."""
    names = [c for c in rows.columns if c not in ("uid", "population")]
    long = rows.filter("population is not null").select("population", F.explode(F.array(*[F.struct(F.lit(n).alias("score"), F.col(n).alias("p")) for n in names])).alias("s")).select("population", "s.score", "s.p")
    against = long.filter("population <> 'benign'").withColumn("y", F.lit(1))
    kinds = F.broadcast(against.select("population").distinct())
    base = long.filter("population = 'benign'").drop("population").join(kinds).withColumn("y", F.lit(0)).select(*against.columns)
    both = against.unionByName(base)
    n = against.groupBy("population", "score").agg(F.count("*").alias("n"))
    return auroc(both, ["population", "score"]).join(n, ["population", "score"])


def open_set_rates(rows: DataFrame) -> DataFrame:
    """population, score, tpr_at_fpr_5, tpr_at_fpr_1 against benign of rows as in open_set_report; a ROC for each population and score."""
    names = [c for c in rows.columns if c not in ("uid", "population")]
    out = None
    for kind in ("known", "unknown"):
        for name in names:
            screening = rows.filter(F.col("population").isin(kind, "benign")).select((F.col("population") == kind).cast("int").alias("threat"), F.col(name).alias("score"))
            one = bag_report(screening).filter("n_threat > 0").select(F.lit(kind).alias("population"), F.lit(name).alias("score"), "tpr_at_fpr_5", "tpr_at_fpr_1")
            out = one if out is None else out.unionByName(one)
    return out
