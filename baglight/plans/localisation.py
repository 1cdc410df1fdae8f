"""Queries for boxes, masks, cascades, anomaly scores and the open-set test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baglight.functions import geometry as G
from baglight.operators import anomaly, cascade, detection
from baglight.plans.bindings import BOXES, INDEX, IOU, PREDS, SCANS, det_boxes, gt_boxes, index, preds, scans
from baglight.plans.recognition import _AP, rounded
from baglight.sources.tables import table

GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
HELD_OUT = [8, 11]


def peaks(s: SparkSession, d: str) -> DataFrame:
    """uid, cls, x, y: a point for each pair of scan and class, beside its first box."""
    b = gt_boxes(s, d).groupBy("uid", "cls").agg(F.min("x1").alias("x"), F.max("y2").alias("y"))
    return b.select("uid", "cls", (F.col("x") + 40.0).alias("x"), (F.col("y") - 25.0).alias("y"))


def crops(s: SparkSession, d: str) -> DataFrame:
    """uid, k, cls, p: three crops for two of three scans, their scores made from the scan's."""
    p = preds(s, d).filter("uid % 3 <> 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return p.select("uid", "k", "cls", F.round(F.col("p") * (1 - F.col("k") * 0.2) + F.col("y") * 0.1 * F.col("k"), 6).alias("p"))


CROPS = PREDS + """,
crops as (select uid, k, cls, round(p * (1 - k * 0.2e0) + y * 0.1e0 * k, 6) as p from preds, (select unnest(range(3)) as k) where uid % 3 <> 0),
agg as (select uid, cls, max(p) as p2 from crops where k < 2 group by all),
fused as (select p.uid, p.cls, p.y, p.p as s1, coalesce(a.p2, 0) as s2, h.uid is not null as has from preds p left join agg a using (uid, cls) left join (select distinct uid from agg) h using (uid))"""


def _fused(s: SparkSession, d: str) -> DataFrame:
    return cascade.fuse(preds(s, d), cascade.crop_scores(crops(s, d), 2), 0.3)


def cells(s: SparkSession, d: str) -> DataFrame:
    """uid, v, g: a row a value of an embedding as a map of cells."""
    e = table(s, d, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("uid"), "label", F.posexplode("embedding").alias("i", "x"))
    g = F.when(F.col("label") % 3 == 0, 0).otherwise((F.col("i") % 5 == F.col("label") % 5).cast("int"))
    return e.select("uid", F.floor(F.col("i") / 8).cast("int").alias("r"), (F.col("i") % 8).alias("c"), F.col("x").cast("double").alias("v"), g.alias("g"))


CELLS = """
val as (select vec_id as uid, label, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings),
cells as (select uid, i // 8 as r, i % 8 as c, v, case when label % 3 = 0 then 0 else (i % 5 = label % 5)::int end as g from val)"""


def open_set(s: SparkSession, d: str) -> DataFrame:
    r = scans(s, d, "labels", "mask_frac", "bag_frac").withColumn("population", cascade.population(F.col("labels"), HELD_OUT)).filter("mask_frac is not null and bag_frac is not null")
    return cascade.open_set_report(r.select("uid", "population", F.col("mask_frac").alias("mask"), F.greatest("mask_frac", F.col("bag_frac") / 10).alias("fused")))


def _props(s: SparkSession, d: str) -> DataFrame:
    return det_boxes(s, d).withColumn("peak", F.col("score"))


QUERIES = {
    "box_iou_pairs": lambda s, d: rounded(detection.iou_pairs(det_boxes(s, d), gt_boxes(s, d), 0.1)),
    "box_match": lambda s, d: detection.matched(det_boxes(s, d), gt_boxes(s, d)).select("uid", "k", "cls", "tp"),
    "box_ap50": lambda s, d: rounded(detection.box_ap(det_boxes(s, d), gt_boxes(s, d))),
    "proposal_recall": lambda s, d: rounded(detection.proposal_recall(det_boxes(s, d), gt_boxes(s, d))),
    "pointing_game": lambda s, d: rounded(detection.pointing_game(peaks(s, d), gt_boxes(s, d))),
    "proposal_sweep": lambda s, d: rounded(detection.proposal_sweep(det_boxes(s, d), gt_boxes(s, d), index(s, d).select("uid"), GRID, 0.8)),
    "topk_boxes": lambda s, d: rounded(detection.top_boxes(table(s, d, "embeddings", "vec_id").select(F.col("vec_id").alias("uid"), F.lit(1).alias("k"), ((F.col("vec_id") % 7) / 7.0).alias("peak")), preds(s, d).select("uid", "cls", "p"))),
    "square_regions": lambda s, d: rounded(gt_boxes(s, d).select("uid", "k", G.square_region(G.box(), 1.5, 48).alias("r")).select("uid", "k", "r.*")),
    "letterbox": lambda s, d: rounded(index(s, d, "img_w", "img_h").select("uid", G.letterbox(F.col("img_w"), F.col("img_h"), 512).alias("b")).select("uid", "b.*")),
    "boxes_to_cache": lambda s, d: rounded(_to_cache(s, d)),
    "boxes_from_cache": lambda s, d: rounded(_from_cache(s, d)),
    "seg_dice": lambda s, d: rounded(detection.seg_report(cells(s, d), 0.0)),
    "pixel_auroc": lambda s, d: rounded(_pixel_auroc(s, d)),
    "crop_fusion": lambda s, d: rounded(_fused(s, d)),
    "alpha_sweep": lambda s, d: rounded(cascade.tune_alpha(_fused(s, d))),
    "openset_report": lambda s, d: rounded(open_set(s, d)),
    "robust_z": lambda s, d: rounded(anomaly.robust_z(table(s, d, "events", "event_id", "value"), "value").select("event_id", "z")),
    "nn_anomaly": lambda s, d: rounded(anomaly.nearest(table(s, d, "embeddings", "vec_id", "embedding"), table(s, d, "embeddings", "vec_id", "embedding", "label").filter("label = 0").select(F.col("vec_id").alias("bank_id"), "embedding"), "vec_id", "embedding"), 4),
    "topk_mean": lambda s, d: rounded(anomaly.top_mean(cells(s, d))),
    "masked_max": lambda s, d: rounded(anomaly.masked_max(cells(s, d))),
    "blur_maps": lambda s, d: rounded(anomaly.blur(cells(s, d), 8, 8), 5),
    "logits": lambda s, d: rounded(preds(s, d).select("uid", "cls", G.logit(F.col("p")).alias("z"))),
    "k_centre": lambda s, d: anomaly.k_centre(table(s, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 16),
}


def _placed(s: SparkSession, d: str) -> DataFrame:
    sized = index(s, d, "img_w", "img_h").select("uid", "img_w", "img_h", G.letterbox(F.col("img_w"), F.col("img_h"), 512).alias("b")).filter("b is not null")
    return gt_boxes(s, d).join(sized.select("uid", "img_w", "img_h", "b.*"), "uid")


def _boxed(df: DataFrame, b: G.Box) -> DataFrame:
    return df.select("uid", "k", *[v.alias(c) for v, c in zip(b, ("x1", "y1", "x2", "y2"), strict=True)])


def _to_cache(s: SparkSession, d: str) -> DataFrame:
    return _boxed(_placed(s, d), G.to_cache(G.box(), F.col("scale"), F.col("pad_x"), F.col("pad_y")))


def _from_cache(s: SparkSession, d: str) -> DataFrame:
    return _boxed(_placed(s, d), G.from_cache(G.box(), F.col("scale"), F.col("pad_x"), F.col("pad_y"), F.col("img_w"), F.col("img_h")))


def _pixel_auroc(s: SparkSession, d: str) -> DataFrame:
    from baglight.operators.recognition import auroc

    return auroc(cells(s, d).select(F.lit(0).alias("all"), F.col("g").alias("y"), F.col("v").alias("p")), ["all"]).select("auroc")


_PLACED = BOXES + """,
siz as (select uid, img_w, img_h, least(512e0 / img_w, 512e0 / img_h) as scale from idx where img_w > 0 and img_h > 0),
fit as (select *, floor((512 - greatest(round_even(img_w * scale, 0), 1)) / 2)::int as pad_x, floor((512 - greatest(round_even(img_h * scale, 0), 1)) / 2)::int as pad_y from siz)"""
_IOA = IOU.replace("(a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)\n   - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))", "(a.x2 - a.x1) * (a.y2 - a.y1)")
_MATCH = f"""
best as (
  select a.uid, a.k, a.cls, a.score, b.k as gk, {IOU} as iou from det a left join gt b on a.uid = b.uid and a.cls = b.cls
  qualify row_number() over (partition by a.uid, a.k order by coalesce({IOU}, -1) desc, b.k) = 1),
taken as (select *, case when iou >= 0.5 then gk end as o from best),
m as (select uid, k, cls, score, (o is not null and row_number() over (partition by uid, cls, o order by score desc, k) = 1)::int as tp from taken)"""

ORACLES = {
    "box_iou_pairs": f"with {BOXES} select a.uid, a.k as ka, b.k as kb, round({IOU}, 6) as iou from det a join gt b using (uid) where {IOU} >= 0.1",
    "box_match": f"with {BOXES}, {_MATCH} select uid, k, cls, tp from m",
    "box_ap50": f"""with {BOXES}, {_MATCH},
tot as (select cls, count(*) as boxes from gt group by cls),
r as (select m.*, boxes, sum(tp) over w / (row_number() over w)::double as prec from m join tot using (cls) window w as (partition by cls order by score desc, uid, k)),
e as (select *, max(prec) over (partition by cls order by score desc, uid, k rows between current row and unbounded following) as env from r)
select cls, round(coalesce(sum(tp * env / e.boxes), 0), 6) as ap, tot.boxes from tot left join e using (cls) group by cls, tot.boxes""",
    "proposal_recall": f"""with {BOXES}, p as (select a.uid, a.k, max({IOU}) as iou, max({_IOA}) as ioa from gt a left join det b using (uid) group by all)
select count(*) as boxes, round(avg(coalesce(iou >= 0.5, false)::int), 6) as recall_iou, round(avg((coalesce(iou >= 0.5, false) or coalesce(ioa >= 0.5, false))::int), 6) as recall_any from p""",
    "pointing_game": f"""with {BOXES}, pk as (select uid, cls, min(x1) + 40 as x, max(y2) - 25 as y from gt group by all),
h as (select uid, cls, max((x between x1 - 15 and x2 + 15 and y between y1 - 15 and y2 + 15)::int) as hit from gt join pk using (uid, cls) group by all)
select cls, count(*) as pairs, round(avg(hit), 6) as accuracy from h group by cls""",
    "proposal_sweep": f"""with {BOXES}, g as (select unnest([{', '.join(f'{x}e0' for x in GRID)}]) as thr),
c as (select a.uid, a.k, max(case when {IOU} >= 0.5 or {_IOA} >= 0.5 then b.score end) as score from gt a left join det b using (uid) group by all),
r as (select thr, (select avg(coalesce(score >= thr, false)::int) from c) as recall, (select count(*) from det where score >= thr) / (select count(*) from idx)::double as per_scan from g)
select thr, round(recall, 6) as recall, round(per_scan, 6) as per_scan, row_number() over (order by (per_scan <= 0.8) desc, recall desc, thr desc) = 1 as best from r""",
    "topk_boxes": f"""with {PREDS}, t as (select * from preds qualify row_number() over (partition by uid order by p desc, cls) <= 3)
select uid, 1 as k, cls, round(p * ((uid % 7) / 7e0), 6) as score from t where p * ((uid % 7) / 7e0) >= 0.02""",
    "square_regions": f"""with {BOXES}, q as (select uid, k, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, greatest(greatest(x2 - x1, y2 - y1) * 1.5e0, 48) as s from gt)
select uid, k, round(cx - s / 2, 6) as x1, round(cy - s / 2, 6) as y1, round(cx + s / 2, 6) as x2, round(cy + s / 2, 6) as y2 from q""",
    "letterbox": f"with {_PLACED} select uid, round(scale, 6) as scale, pad_x, pad_y from idx left join fit using (uid)",
    "boxes_to_cache": f"with {_PLACED} select uid, k, round(x1 * scale + pad_x, 6) as x1, round(y1 * scale + pad_y, 6) as y1, round(x2 * scale + pad_x, 6) as x2, round(y2 * scale + pad_y, 6) as y2 from gt join fit using (uid)",
    "boxes_from_cache": f"""with {_PLACED} select uid, k, round(least(greatest((x1 - pad_x) / scale, 0), img_w), 6) as x1, round(least(greatest((y1 - pad_y) / scale, 0), img_h), 6) as y1,
  round(least(greatest((x2 - pad_x) / scale, 0), img_w), 6) as x2, round(least(greatest((y2 - pad_y) / scale, 0), img_h), 6) as y2 from gt join fit using (uid)""",
    "seg_dice": f"""with {CELLS}, u as (select uid, sum((v >= 0 and g > 0)::int) as tp, sum((v >= 0)::int) as p, sum((g > 0)::int) as g, count(*) as n from cells group by uid)
select round(avg(case when g > 0 then 2 * tp / (p + g)::double end), 6) as dice, round(avg(case when g > 0 then tp / (p + g - tp)::double end), 6) as iou,
  round(sum(case when g = 0 then p end) / sum(case when g = 0 then n end)::double, 6) as fp_rate from u""",
    "pixel_auroc": f"""with {CELLS}, r as (select g, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2e0 as rk from cells)
select round((sum(case when g = 1 then rk end) - sum(g) * (sum(g) + 1) / 2e0) / nullif(sum(g) * sum(1 - g), 0), 6) as auroc from r""",
    "crop_fusion": f"""with {CROPS} select uid, cls, y, s1, s2, case when has then greatest(s1, s2) else s1 end as max, round(case when has then 0.3e0 * s1 + 0.7e0 * s2 else s1 end, 6) as blend, has from fused""",
    "alpha_sweep": f"""with {CROPS}, x as (select i, cls, y, case when has then round((i / 10e0) * s1 + (1 - i / 10e0) * s2, 9) else s1 end as p from fused, (select unnest(range(11)) as i)),
{_AP.format(by='i, cls', w='1', rows='x')}, m as (select i, round(avg(ap), 9) as map from ap group by i)
select i / 10e0 as alpha, round(map, 6) as map, row_number() over (order by map desc, i) = 1 as best from m""",
    "openset_report": f"""with {SCANS},
q as (select mask_frac as mask, greatest(mask_frac, bag_frac / 10) as fused, case when len(labels) = 0 then 'benign' when len(list_filter(labels, lambda x: x not in ({', '.join(map(str, HELD_OUT))}))) = 0 then 'unknown'
  when not list_has_any(labels, {HELD_OUT}) then 'known' end as population from (select * replace (list_filter(labels, lambda x: x is not null) as labels) from scans) where mask_frac is not null and bag_frac is not null),
l as (select population, 'mask' as score, mask as p from q union all select population, 'fused', fused from q),
x as (select population, score, 1 as y, p from l where population in ('known', 'unknown') union all select k, score, 0, p from l, (select unnest(['known', 'unknown']) as k) where population = 'benign'),
r as (select population, score, y, rank() over (partition by population, score order by p) + (count(*) over (partition by population, score, p) - 1) / 2e0 as rk from x)
select population, score, round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * sum(1 - y), 0), 6) as auroc, sum(y)::bigint as n from r group by population, score""",
    "robust_z": """with m as (select median(value) as c from events), s as (select 1.4826e0 * median(abs(value - c)) as s from events, m)
select event_id, round((value - c) / s, 6) as z from events, m, s""",
    "nn_anomaly": """with v as (select vec_id, label, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings),
d as (select a.vec_id, b.vec_id as bid, sqrt(sum((a.x - b.x) * (a.x - b.x))) as dist from v a join v b on a.i = b.i and b.label = 0 and a.vec_id <> b.vec_id group by all)
select vec_id, round(min(dist), 4) as distance from d group by vec_id""",
    "topk_mean": f"with {CELLS}, t as (select uid, v from cells qualify row_number() over (partition by uid order by v desc) <= 10) select uid, round(max(v), 6) as score_max, round(avg(v), 6) as score_top from t group by uid",
    "masked_max": f"with {CELLS} select uid, round(max(case when g <= 0 then v end), 6) as score from cells group by uid",
    "blur_maps": f"""with {CELLS}, k as (select unnest(range(-3, 4)) as o), w as (select o, exp(-0.5e0 * o * o) / (select sum(exp(-0.5e0 * o * o)) from k) as w from k),
one as (select a.uid, a.r, a.c, sum(b.v * a.w) as v from (select * from cells, w) a join cells b on b.uid = a.uid and b.c = a.c and b.r = least(greatest(a.r + a.o, 0), 7) group by all),
two as (select a.uid, a.r, a.c, sum(b.v * a.w) as v from (select * from one, w) a join one b on b.uid = a.uid and b.r = a.r and b.c = least(greatest(a.c + a.o, 0), 7) group by all)
select uid, r, c, round(v, 5) + 0e0 as v from two""",
    "logits": f"with {PREDS}, q as (select uid, cls, least(greatest(p, 1e-6), 1 - 1e-6) as q from preds) select uid, cls, round(ln(q / (1 - q)), 6) as z from q",
}
