"""Queries for object extraction, map regions, patch selection, run states and composed result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baglight.operators import bootstrap, experiments, objects, patches, pixels, recognition as R
from baglight.operators.rows import latest
from baglight.plans.bindings import BOXES, IOU, MODELS, PREDS, SCREENING, det_boxes, gt_boxes, index, models, preds, screening
from baglight.functions.geometry import sigmoid
from baglight.operators import anomaly, ingest, material
from baglight.plans.localisation import CELLS, _IOA, cells
from baglight.plans.recognition import _AP, _BEST, _BOOT, N_BOOT, WHOLE, rounded
from baglight.sources.tables import table


def _files(s: SparkSession, d: str) -> DataFrame:
    return latest(table(s, d, "annotation_files", "file_id", "payload", "read_at"), "file_id", "read_at")


def _maps(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("uid"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("values"))


def result_row(s: SparkSession, d: str, n: int = N_BOOT) -> DataFrame:
    """One row a model: mAP with its interval, macro AUROC, and F1 at the thresholds tuned on the same rows."""
    m = models(s, d)
    point = R.average_precision(m, ["model", "cls"]).groupBy("model").agg(F.avg("ap").alias("map"))
    area = R.auroc(m, ["model", "cls"]).groupBy("model").agg(F.avg("auroc").alias("auroc"))
    interval = bootstrap.map_interval(bootstrap.bootstrap_map(m, n))
    p = preds(s, d)
    f1 = R.f1_report(p, R.thresholds(p)).select(F.lit("a").alias("model"), "macro_f1", "micro_f1")
    return point.join(area, "model").join(interval, "model").join(f1, "model", "left")


def _states(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    key = F.col("n_nationkey")
    specs = n.select(key.cast("string").alias("name"), F.when(key > 0, F.array(F.floor(key / 2).cast("string"))).otherwise(F.array().cast("array<string>")).alias("needs"))
    name = key.cast("string").alias("name")
    return experiments.states(specs, n.filter("n_regionkey in (0, 1)").select(name), n.filter("n_regionkey = 2").select(name))


QUERIES = {
    "object_extract": lambda s, d: objects.extract_objects(_files(s, d)),
    "annotation_styles": lambda s, d: _files(s, d).select(objects.style(F.col("payload")).alias("style")).groupBy("style").agg(F.count("*").alias("n")),
    "map_proposals": lambda s, d: rounded(pixels.proposals(_maps(s, d), 8, 8, 0.2, 3)),
    "donors": lambda s, d: patches.donors(gt_boxes(s, d), 1 << 30).select("uid", "k", "cls"),
    "donors_capped": lambda s, d: patches.donors(gt_boxes(s, d), 50).select("uid", "k", "cls"),
    "hard_negatives": lambda s, d: patches.hard_negatives(det_boxes(s, d), gt_boxes(s, d)).select("uid", "k"),
    "background_boxes": lambda s, d: patches.background_boxes(index(s, d, "img_w", "img_h").filter("img_w > 64 and img_h > 64").select("uid", F.col("img_w").alias("w"), F.col("img_h").alias("h")), gt_boxes(s, d), 3, [32, 48, 64]),
    "result_row": lambda s, d: rounded(result_row(s, d)),
    "result_row_1000": lambda s, d: rounded(result_row(s, d, WHOLE)),
    "mask_loss": lambda s, d: rounded(material.mask_loss(cells(s, d).select(sigmoid(F.col("v")).alias("p"), "g"))),
    "weighted_bce": lambda s, d: rounded(preds(s, d).groupBy("cls").agg(F.avg(material.cross_entropy(F.col("y"), F.col("p"), F.when(F.col("y") == 1, 2.0).otherwise(1.0))).alias("loss"))),
    "cosine_schedule": lambda s, d: rounded(table(s, d, "part", "p_partkey").select("p_partkey", material.cosine_rate(F.col("p_partkey") % 200, 200, 10, 0.05).alias("rate"))),
    "first_match": lambda s, d: table(s, d, "part", "p_partkey", "p_name").select("p_partkey", material.first_match(F.col("p_name"), [("a", 1.0), ("e", 2.0)], 0.5).alias("rate")),
    "price_log_histogram": lambda s, d: ingest.log_histogram(table(s, d, "lineitem", "l_extendedprice"), "l_extendedprice", 39),
    "dilated_masks": lambda s, d: anomaly.dilate(cells(s, d).select("uid", "r", "c", "g"), "g").select("uid", "r", "c", "g"),
    "clutter_fit": lambda s, d: rounded(anomaly.clutter_fit(cells(s, d))),
    "bank_sample": lambda s, d: patches.capped(cells(s, d).filter("g = 0"), ["uid"], 16, "uid", "r", "c").select("uid", "r", "c"),
    "run_states": _states,
    "missing_runs": lambda s, d: experiments.missing(table(s, d, "nation", "n_name").select(F.col("n_name").alias("name")), table(s, d, "region", "r_name").select(F.col("r_name").alias("run"))),
    "worst_misses": lambda s, d: rounded(experiments.top_cases(preds(s, d).filter("y = 1"), "cls", "p", 3, "uid", largest=False)),
    "worst_alarms": lambda s, d: experiments.top_cases(screening(s, d).filter("threat = 0"), "threat", "score", 10, "uid"),
}

_MAPS = CELLS + """,
m as (select uid, r, c, abs(v) as v from cells),
on1 as (select * from m where v >= 0.2),
reach1(uid, r, c, id) as (select uid, r, c, r * 8 + c from on1 union select x.uid, x.r, x.c, y.id from reach1 y join on1 x on x.uid = y.uid and abs(x.r - y.r) <= 1 and abs(x.c - y.c) <= 1),
reg1 as (select uid, id, max(v) as peak, min(c) as x1, min(r) as y1, max(c) + 1 as x2, max(r) + 1 as y2 from (select uid, r, c, min(id) as id from reach1 group by all) join m using (uid, r, c) group by uid, id having count(*) >= 2),
rest as (select uid, greatest(0.05e0, max(v) / 2) as thr from m where uid not in (select uid from reg1) group by uid),
on2 as (select m.* from m join rest using (uid) where v >= thr),
reach2(uid, r, c, id) as (select uid, r, c, r * 8 + c from on2 union select x.uid, x.r, x.c, y.id from reach2 y join on2 x on x.uid = y.uid and abs(x.r - y.r) <= 1 and abs(x.c - y.c) <= 1),
reg2 as (select uid, id, max(v) as peak, min(c) as x1, min(r) as y1, max(c) + 1 as x2, max(r) + 1 as y2 from (select uid, r, c, min(id) as id from reach2 group by all) join m using (uid, r, c) group by uid, id),
every as (select * from reg1 union all select * from reg2),
prop as (select uid, row_number() over (partition by uid order by peak desc, x1, y1, x2, y2) - 1 as k, peak, x1, y1, x2, y2 from every qualify k < 3)"""

_U = "(('0x' || substr(md5('0:' || d.uid || ':' || d.k || ':{}'), 1, 8))::bigint / 4294967296e0)"
_IOB = _IOA.replace("a.", "#.").replace("b.", "a.").replace("#.", "b.")
_BACKGROUND = BOXES + f""",
draw as (select uid, img_w as w, img_h as h, unnest(range(90)) as k from idx where img_w > 64 and img_h > 64),
sized as (select d.uid, d.k, d.w, d.h, least([32e0, 48e0, 64e0][floor({_U.format('s')} * 3)::int + 1], d.w, d.h) as side from draw d),
made as (select d.uid, d.k, d.side, floor({_U.format('x')} * (d.w - d.side)) as x1, floor({_U.format('y')} * (d.h - d.side)) as y1 from sized d),
spot as (select uid, k, x1, y1, x1 + side as x2, y1 + side as y2 from made),
rand as (select a.* from spot a where not exists (select 1 from gt b where b.uid = a.uid and ({_IOA} > 0.1 or {_IOB} > 0.1)) qualify row_number() over (partition by a.uid order by a.k) <= 3)"""

ORACLES = {
    "map_proposals": f"with recursive {_MAPS} select uid, k, round(peak, 6) as peak, x1, y1, x2, y2 from prop",
    "mask_loss": f"""with {CELLS}, q as (select 1 / (1 + exp(-v)) as p, g from cells), c as (select least(greatest(p, 1e-8), 1 - 1e-8) as c, p, g from q)
select round(avg(-(g * ln(c) + (1 - g) * ln(1 - c))) + 1 - (2 * sum(p * g) + 1) / (sum(p) + sum(g) + 1), 6) as loss from c""",
    "weighted_bce": f"with {PREDS}, c as (select cls, y, least(greatest(p, 1e-8), 1 - 1e-8) as q from preds) select cls, round(avg(case when y = 1 then -2 * ln(q) else -ln(1 - q) end), 6) as loss from c group by cls",
    "cosine_schedule": """with s as (select p_partkey, p_partkey % 200 as s from part)
select p_partkey, round(case when s < 10 then (s + 1) / 10e0 else 0.05e0 + 0.95e0 * 0.5e0 * (1 + cos(pi() * (s - 10) / 190e0)) end, 6) as rate from s""",
    "first_match": "select p_partkey, case when lower(p_name) like '%a%' then 1e0 when lower(p_name) like '%e%' then 2e0 else 0.5e0 end as rate from part",
    "price_log_histogram": """with v as (select ln(l_extendedprice) as v from lineitem where l_extendedprice > 0), e as (select min(v) as lo, max(v) as hi from v)
select least(floor((v - lo) / (hi - lo) * 39), 38)::int as bin, count(*) as n from v, e group by bin""",
    "dilated_masks": f"with {CELLS} select a.uid, a.r, a.c, max(b.g) as g from cells a join cells b on a.uid = b.uid and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 group by a.uid, a.r, a.c",
    "clutter_fit": f"with {CELLS}, o as (select v from cells where g <= 0), m as (select median(v) as m from o) select round(m, 6) as centre, round(1.4826e0 * median(abs(v - m)), 6) as spread from o, m group by m",
    "annotation_styles": """with f as (select payload from annotation_files qualify row_number() over (partition by file_id order by read_at desc) = 1),
j as (select case when json_valid(payload) then payload::json end as j from f),
k as (select j, json_type(j, '$.shapes') as s, json_type(j, '$.annotations') as a, json_type(j, '$.images') as i, json_exists(j, '$.imagePath') or json_exists(j, '$.version') as p from j)
select case when j is null then null when s = 'ARRAY' and p then 'labelme' when a = 'ARRAY' and i = 'ARRAY' then 'coco' else 'other' end as style, count(*) as n from k group by style""",
    "donors": f"with {BOXES} select a.uid, a.k, a.cls from gt a where not exists (select 1 from gt b where b.uid = a.uid and b.k <> a.k and {_IOA} > 0.3)",
    "donors_capped": f"""with {BOXES} select a.uid, a.k, a.cls from gt a where not exists (select 1 from gt b where b.uid = a.uid and b.k <> a.k and {_IOA} > 0.3)
qualify row_number() over (partition by a.cls order by md5('0:' || a.uid || ':' || a.k), a.uid, a.k) <= 50""",
    "bank_sample": f"with {CELLS} select uid, r, c from cells where g = 0 qualify row_number() over (partition by uid order by md5('0:' || uid || ':' || r || ':' || c), uid, r, c) <= 16",
    "background_boxes": f"""with {_BACKGROUND} select uid, k, x1, y1, x2, y2 from rand""",
    "hard_negatives": f"""with {BOXES}, f as (select a.uid, a.k from det a where not exists (select 1 from gt b where b.uid = a.uid and {_IOA} > 0.1))
select uid, k from f qualify row_number() over (partition by uid order by k) <= 3""",
    "result_row": f"""{_BOOT}, {_AP.format(by='model, cls', w='1', rows='models').replace('step as', 'pstep as').replace('from step', 'from pstep').replace('cum as', 'pcum as').replace('from cum', 'from pcum').replace('ap as (', 'pap as (', 1)},
r as (select model, cls, y, rank() over (partition by model, cls order by p) + (count(*) over (partition by model, cls, p) - 1) / 2e0 as rk from models),
ar as (select model, cls, (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * sum(1 - y), 0) as au from r group by model, cls), {_BEST},
per as (select cls, sum(case when p >= thr then y else 0 end) as tp, sum((p >= thr)::int) as called, sum(y) as pos from preds join best using (cls) group by cls),
f as (select 'a' as model, avg(case when pos > 0 then 2 * tp / greatest(called + pos, 1)::double end) as macro_f1, 2 * sum(tp) / greatest(sum(called) + sum(pos), 1)::double as micro_f1 from per)
select m.model, round((select avg(ap) from pap where pap.model = m.model), 6) as map, round((select avg(au) from ar where ar.model = m.model), 6) as auroc,
  round(quantile_cont(map, 0.025), 6) as lo, round(quantile_cont(map, 0.975), 6) as hi, round(any_value(macro_f1), 6) as macro_f1, round(any_value(micro_f1), 6) as micro_f1
from maps m left join f on f.model = m.model group by m.model""",
    "run_states": """with s as (select n_nationkey as k, n_regionkey in (0, 1) as d, n_regionkey = 2 as b from nation)
select s.k::varchar as name, case when s.d then 'done' when s.b then 'started' when s.k > 0 and not p.d then 'waiting' else 'ready' end as state from s left join s p on p.k = s.k // 2""",
    "missing_runs": "select n_name as name from nation where n_name not in (select r_name from region)",
    "worst_misses": f"with {PREDS} select uid, cls, y, p, row_number() over (partition by cls order by p, uid) as place from preds where y = 1 qualify place <= 3",
    "worst_alarms": f"with {SCREENING} select uid, threat, score, row_number() over (order by score desc, uid) as place from screening where threat = 0 qualify place <= 10",
}
