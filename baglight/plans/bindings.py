"""What the reference operators' queries run on, built from the test tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baglight.operators.rows import latest
from baglight.sources.tables import table


def preds(spark: SparkSession, d: str) -> DataFrame:
    """uid, cls, y, p: each embedding against each class, by its distance to the class centroid."""
    emb = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    values = emb.select("label", F.posexplode("embedding").alias("pos", "v"))
    mean = values.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    # A row a class, whatever the number of embeddings.
    centre = mean.groupBy(F.col("label").alias("cls")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x.m).alias("c"))
    gap = F.aggregate(F.zip_with("embedding", "c", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    scored = emb.crossJoin(F.broadcast(centre)).withColumn("s", gap)
    return scored.select(F.col("vec_id").alias("uid"), "cls", (F.col("label") == F.col("cls")).cast("int").alias("y"), F.round(1 / (1 + F.exp(F.col("s") - 1)), 6).alias("p"))


PREDS = """
val as (select vec_id, label, unnest(range(len(embedding))) as pos, unnest(embedding)::double as v from embeddings),
cen as (select label as cls, pos, avg(v) as m from val group by all),
dist as (select vec_id, label, cls, sum((v - m) * (v - m)) as s from val join cen using (pos) group by all),
preds as (select vec_id as uid, cls, (label = cls)::int as y, round(1 / (1 + exp(s - 1)), 6) as p from dist)"""


def models(spark: SparkSession, d: str) -> DataFrame:
    """model, uid, cls, y, p: the predictions and a coarser copy of them."""
    p = preds(spark, d)
    return p.select(F.lit("a").alias("model"), "*").union(p.select(F.lit("b"), "uid", "cls", "y", F.round(F.sqrt("p"), 2)))


MODELS = PREDS + """,
models as (select 'a' as model, * from preds union all select 'b', uid, cls, y, round(sqrt(p), 2) from preds)"""


def scans(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current rows of scan_split."""
    return latest(table(spark, d, "scan_split", "uid", "run_at", *columns), "uid", "run_at").drop("run_at")


SCANS = """
scans as (select * from scan_split where uid is not null qualify row_number() over (partition by uid order by run_at desc) = 1)"""


def index(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current rows of scan_index."""
    return latest(table(spark, d, "scan_index", "uid", "indexed_at", *columns), "uid", "indexed_at").drop("indexed_at")


INDEX = """
idx as (select * from scan_index where uid is not null qualify row_number() over (partition by uid order by indexed_at desc) = 1)"""


def gt_boxes(spark: SparkSession, d: str) -> DataFrame:
    """uid, k, cls, x1, y1, x2, y2 of every mapped box of the index, k from 1."""
    b = index(spark, d, "boxes").select("uid", F.posexplode("boxes").alias("pos", "b")).filter("b is not null")
    return b.select("uid", (F.col("pos") + 1).cast("long").alias("k"), "b.cls", "b.x1", "b.y1", "b.x2", "b.y2").filter("cls >= 0")


def det_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Detections made from the boxes: shifted by place, every third with the next class, scores with many ties."""
    k = F.col("k")
    moved = lambda c, m, f: (F.col(c) + F.pmod(k, F.lit(m)) * f).alias(c)
    cls = F.when(k % 3 == 0, (F.col("cls") + 1) % 20).otherwise(F.col("cls")).cast("int").alias("cls")
    score = (F.pmod(F.col("x1").cast("long") * 31 + k * 17, F.lit(97)) / F.lit(97.0)).alias("score")
    return gt_boxes(spark, d).select("uid", "k", cls, moved("x1", 5, 3.0), moved("y1", 4, 3.0), moved("x2", 5, 3.0), moved("y2", 2, 4.0), score)


BOXES = INDEX + """,
gt as (
  select uid, k, b.cls as cls, b.x1 as x1, b.y1 as y1, b.x2 as x2, b.y2 as y2
  from (select uid, unnest(boxes) as b, unnest(range(1, len(boxes) + 1)) as k from idx) where b is not null and b.cls >= 0),
det as (
  select uid, k, case when k % 3 = 0 then (cls + 1) % 20 else cls end as cls, x1 + (k % 5) * 3e0 as x1, y1 + (k % 4) * 3e0 as y1,
         x2 + (k % 5) * 3e0 as x2, y2 + (k % 2) * 4e0 as y2, ((trunc(x1)::bigint * 31 + k * 17) % 97) / 97e0 as score
  from gt)"""

IOU = """
(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))
 / greatest((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
   - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)), 1e-6))"""


def screening(spark: SparkSession, d: str) -> DataFrame:
    """uid, threat, score: whether a scan carries a threat, and the part of its picture that is masked."""
    return scans(spark, d, "is_threat", "mask_frac").filter("is_threat is not null and mask_frac is not null").select("uid", F.col("is_threat").cast("int").alias("threat"), F.col("mask_frac").alias("score"))


SCREENING = SCANS + """,
screening as (select uid, is_threat::int as threat, mask_frac as score from scans where is_threat is not null and mask_frac is not null)"""


def first_of(df: DataFrame, by: list[str], *order) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")
