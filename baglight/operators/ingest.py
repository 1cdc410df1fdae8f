"""From annotation objects to the index: box layout, class rules, audits and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baglight.functions import geometry as G
from baglight.functions.labels import label_class


def label_counts(labels: DataFrame, column: str) -> DataFrame:
    """raw, cls, status, n: each spelling with the class it is read as. Spellings are counted first, so each is judged once."""
    count = labels.groupBy(F.col(column).alias("raw")).agg(F.count("*").alias("n"))
    return count.withColumn("m", label_class(F.col("raw"))).select("raw", "m.cls", "m.status", "n")


def box_layout(raw: DataFrame) -> DataFrame:
    """One row: layout ('xyxy' or 'xywh'), n, wrong_order, iou_xyxy, iou_xywh of raw boxes (v1..v4) beside the true bounds (x1..y2).

    Any box whose second corner comes before its first settles for 'xywh'; else the better mean IoU, ties to 'xyxy'.
    """
    v = [F.col(f"v{i}") for i in range(1, 5)]
    truth = G.box()
    as_size = (v[0], v[1], v[0] + v[2], v[1] + v[3])
    wrong = ((v[2] < v[0]) | (v[3] < v[1])).cast("int")
    r = raw.agg(F.count("*").alias("n"), F.sum(wrong).alias("wrong_order"), F.avg(G.iou(tuple(v), truth)).alias("iou_xyxy"), F.avg(G.iou(as_size, truth)).alias("iou_xywh"))
    size = (F.col("wrong_order") > 0) | (F.col("iou_xywh") > F.col("iou_xyxy"))
    return r.select(F.when(size, "xywh").otherwise("xyxy").alias("layout"), "*")


def folder_rules(scans: DataFrame) -> DataFrame:
    """uid, labels, issue of scans (uid, folder_id, found): the class rules of folders.

    A benign folder (22) has no labels, and an issue if objects were found; a folder of several
    classes (21) has those found; any other folder's class holds, whatever was found.
    """
    found = F.array_sort(F.array_distinct(F.filter(F.coalesce("found", F.array().cast("array<int>")), lambda c: c.isNotNull() & (c >= 0))))
    own = F.array(F.col("folder_id") - 1)
    labels = F.when(F.col("folder_id") == 22, F.array().cast("array<int>")).when(F.col("folder_id") == 21, found).otherwise(own)
    other = F.size(F.array_except(found, own)) > 0
    issue = F.when((F.col("folder_id") == 22) & (F.size(found) > 0), "benign_with_objects").when((F.col("folder_id") < 21) & other, "label_conflict").when((F.col("folder_id") == 21) & (F.size(found) == 0), "no_objects").otherwise("")
    return scans.select("uid", labels.alias("labels"), issue.alias("issue"))


def label_matrix(scans: DataFrame, ids: int) -> DataFrame:
    """uid, row: a list of 0 and 1 for each class below ids; null labels have none."""
    return scans.select("uid", F.transform(F.sequence(F.lit(0), F.lit(ids - 1)), lambda c: F.coalesce(F.array_contains(F.array_compact("labels"), c), F.lit(False)).cast("int")).alias("row"))


def by_stem(left: DataFrame, right: DataFrame, keys: list[str], path: str) -> DataFrame:
    """left with the least `path` of right under the same keys: the first file wins."""
    return left.join(right.groupBy(*keys).agg(F.min(path).alias(path)), keys, "left")


def safe_uids(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Adds uid: the name, with _2, _3, ... for further rows of one name in the given order."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("uid", F.when(n == 1, F.col(name)).otherwise(F.concat(name, F.lit("_"), n.cast("string"))))


def overview(scans: DataFrame) -> DataFrame:
    """split, scans, threat, multi, clean, clean_pct."""
    n = F.coalesce("n_labels", F.lit(0))
    flag = lambda c: F.sum(c.cast("int"))
    g = scans.groupBy("split").agg(F.count("*").alias("scans"), flag(n > 0).alias("threat"), flag(n > 1).alias("multi"), flag(n == 0).alias("clean"))
    return g.withColumn("clean_pct", F.col("clean") * 100 / F.col("scans"))


def class_ratio(scans: DataFrame) -> DataFrame:
    """cls, train, test, ratio of the splits' scans of a class (ratio null without train scans)."""
    long = scans.select("split", "uid", F.explode(F.array_distinct(F.array_compact("labels"))).alias("cls"))
    of = lambda s: F.sum((F.col("split") == s).cast("int"))
    g = long.groupBy("cls").agg(of("train").alias("train"), of("test").alias("test"))
    return g.withColumn("ratio", F.expr("try_divide(test, train)"))


def describe(rows: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, std (sample), least, q25, median, q75, most."""
    v = F.col(column)
    q = F.percentile(v, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    r = rows.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), q.alias("q"), F.max(v).alias("most"))
    return r.select("n", "mean", "std", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "most")


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, n over `bins` equal bins from the least to the greatest finite value; the last bin holds its upper end."""
    v = F.col(column).cast("double")
    ok = rows.filter(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    ends = ok.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return ok.join(F.broadcast(ends)).select(F.coalesce(F.when(F.col("hi") > F.col("lo"), at), F.lit(0)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def word_shares(rows: DataFrame, column: str, words: list[str]) -> DataFrame:
    """word, share of the texts that contain it, upper and lower case alike; null texts contain none."""
    text = F.lower(F.coalesce(column, F.lit("")))
    r = rows.agg(*[F.avg(text.contains(w).cast("double")).alias(f"w{i}") for i, w in enumerate(words)])
    return r.select(F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"w{i}").alias("share")) for i, w in enumerate(words)])).alias("r")).select("r.*")


def log_histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, n over `bins` bins of equal width of the logarithm of the positive values; the last bin holds its upper end."""
    v = F.col(column).cast("double")
    return histogram(rows.filter(v > 0).select(F.ln(v).alias("v")), "v", bins)
