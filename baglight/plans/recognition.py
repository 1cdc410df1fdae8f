"""Queries for recognition, screening and bootstrap metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baglight.operators import bootstrap, recognition as R
from baglight.plans.bindings import BOXES, MODELS, PREDS, SCREENING, gt_boxes, models, preds, screening
from baglight.sources.tables import table

#: Replicates of the queries that are compared with their SQL, and of the whole job.
N_BOOT, WHOLE = 50, 1000


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def lookalike_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "class_names").filter("lookalike is not null").select(F.col("class_id").alias("cls"), F.col("lookalike").alias("grp"))


def areas(spark: SparkSession, d: str) -> DataFrame:
    """uid, cls, value of every box: its area."""
    return gt_boxes(spark, d).select("uid", "cls", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("value"))


def box_strata(spark: SparkSession, d: str) -> DataFrame:
    v = areas(spark, d)
    return R.pair_strata(v, R.terciles(v, "value"))


def _ap_strata(spark: SparkSession, d: str) -> DataFrame:
    """Predictions by strata of the embedding's first value."""
    emb = table(spark, d, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("uid"), F.col("label").alias("cls"), F.col("embedding")[0].cast("double").alias("value"))
    return R.stratified_ap(preds(spark, d), R.pair_strata(emb, R.terciles(emb, "value")))


QUERIES = {
    "ap_per_class": lambda s, d: rounded(R.average_precision(preds(s, d), ["cls"])),
    "map_overall": lambda s, d: rounded(R.mean_ap(preds(s, d))),
    "auroc_per_class": lambda s, d: rounded(R.auroc(preds(s, d), ["cls"])),
    "best_f1_threshold": lambda s, d: rounded(R.thresholds(preds(s, d))),
    "recall_threshold": lambda s, d: rounded(R.recall_thresholds(preds(s, d))),
    "f1_report": lambda s, d: rounded(R.f1_report(preds(s, d), R.thresholds(preds(s, d)))),
    "bag_scores": lambda s, d: R.bag_scores(preds(s, d)),
    "bag_screening": lambda s, d: rounded(R.bag_report(screening(s, d))),
    "roc_points": lambda s, d: rounded(R.roc(screening(s, d))),
    "recall_clearance": lambda s, d: rounded(R.recall_clearance(screening(s, d))),
    "confusion": lambda s, d: rounded(R.confusion_shares(R.confusion(preds(s, d)))),
    "lookalike_groups": lambda s, d: R.lookalikes(R.confusion(preds(s, d)), lookalike_classes(s, d)),
    "tercile_edges": lambda s, d: rounded(R.terciles(table(s, d, "lineitem", "l_extendedprice"), "l_extendedprice")),
    "box_strata": box_strata,
    "stratified_ap": lambda s, d: rounded(_ap_strata(s, d)),
    "bootstrap_map_ci": lambda s, d: rounded(bootstrap.map_interval(bootstrap.bootstrap_map(models(s, d), N_BOOT))),
    "paired_delta": lambda s, d: rounded(bootstrap.paired_delta(bootstrap.bootstrap_map(models(s, d), N_BOOT), "a", "b")),
    "auroc_ci": lambda s, d: rounded(bootstrap.auroc_interval(screening(s, d), N_BOOT)),
    "bootstrap_map_ci_1000": lambda s, d: rounded(bootstrap.map_interval(bootstrap.bootstrap_map(models(s, d), WHOLE))),
    "paired_delta_1000": lambda s, d: rounded(bootstrap.paired_delta(bootstrap.bootstrap_map(models(s, d), WHOLE), "a", "b")),
    "auroc_ci_1000": lambda s, d: rounded(bootstrap.auroc_interval(screening(s, d), WHOLE)),
}

_AP = """
step as (select {by}, p, sum({w} * y) as tp, sum({w}) as n from {rows} group by {by}, p),
cum as (select *, sum(tp) over (partition by {by} order by p desc) as tpc, sum(n) over (partition by {by} order by p desc) as nc from step),
ap as (
  select {by}, case when sum(tp) > 0 and sum(tp) < sum(n) then sum(tp * tpc::double / nc) / sum(tp) end as ap, sum(tp)::bigint as positives
  from cum group by {by})"""
_W = ("case when u < 0.36788 then 0 when u < 0.73576 then 1 when u < 0.91970 then 2 when u < 0.98101 then 3 when u < 0.99634 then 4 when u < 0.99941 then 5 else 6 end")
_REP = """
rep as (
  select * from (select *, {w} as w from (
    select r.*, b, ('0x' || substr(md5('0:' || b || ':' || uid), 1, 8))::bigint / 4294967296e0 as u
    from {rows} r, (select unnest(range({n})) as b))) where w > 0)"""
_BEST = """
grid as (select 0.02e0 + i * 0.02e0 as thr, i from (select unnest(range(49)) as i)),
sweep as (
  select cls, thr, i, round(2 * sum(case when p >= thr then y else 0 end) / greatest(sum((p >= thr)::int) + sum(y), 1)::double, 9) as f1, sum(y) as pos
  from preds, grid group by cls, thr, i),
best as (
  select cls, case when pos > 0 then round(thr, 6) else 0.5 end as thr, f1 from sweep
  qualify row_number() over (partition by cls order by f1 desc, i) = 1)"""
_CONF = """
one as (select uid, max(case when y = 1 then cls end) as actual from preds group by uid having sum(y) = 1),
top as (select uid, cls as called from preds qualify row_number() over (partition by uid order by p desc, cls) = 1),
conf as (select actual, called, count(*) as n from one join top using (uid) group by all)"""
_ROC = """
pt as (
  select score, (select count(*) from screening x where x.threat = 0 and x.score >= s.score) / nullif((select sum(1 - threat) from screening), 0)::double as fpr,
         (select count(*) from screening x where x.threat = 1 and x.score >= s.score) / nullif((select sum(threat) from screening), 0)::double as tpr
  from (select distinct score from screening) s)"""
_BOOT = f"with {MODELS}, {_REP.format(rows='models', n=N_BOOT, w=_W)}, {_AP.format(by='b, model, cls', w='w', rows='rep')}, maps as (select b, model, avg(ap) as map from ap group by all)"
_TPR = """(with q as (select 0e0 as fpr, 0e0 as hi, 0e0 as lo union all select fpr, max(tpr), min(tpr) from pt group by fpr),
  m as (select fpr, max(hi) as hi, min(lo) as lo from q group by fpr),
  b as (select fpr, hi from m where fpr <= {f} order by fpr desc limit 1), a as (select fpr, lo from m where fpr > {f} order by fpr limit 1)
  select coalesce(b.hi + ({f} - b.fpr) / (a.fpr - b.fpr) * (a.lo - b.hi), b.hi) from b left join a on true)"""
_CLEAR = """(select avg((score < (select score from screening where threat = 1 order by score
  offset (select least(floor((1 - {r}e0) * count(*)), count(*) - 1)::bigint from screening where threat = 1) limit 1))::int) from screening where threat = 0)"""

ORACLES = {
    "ap_per_class": f"with {PREDS}, {_AP.format(by='cls', w='1', rows='preds')} select cls, round(ap, 6) as ap, positives from ap",
    "map_overall": f"with {PREDS}, {_AP.format(by='cls', w='1', rows='preds')} select round(avg(ap), 6) as map from ap",
    "auroc_per_class": f"""with {PREDS}, r as (select cls, y, rank() over (partition by cls order by p) + (count(*) over (partition by cls, p) - 1) / 2e0 as rk from preds)
select cls, round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * sum(1 - y), 0), 6) as auroc from r group by cls""",
    "best_f1_threshold": f"with {PREDS}, {_BEST} select cls, thr, round(f1, 6) as f1 from best",
    "recall_threshold": f"""with {PREDS}, pos as (select cls, p, row_number() over (partition by cls order by p) - 1 as i, count(*) over (partition by cls) as n from preds where y = 1)
select cls, p as thr from pos where i = least(floor((1 - 0.95e0) * n), n - 1)""",
    "f1_report": f"""with {PREDS}, {_BEST},
per as (select cls, sum(case when p >= thr then y else 0 end) as tp, sum((p >= thr)::int) as called, sum(y) as pos from preds join best using (cls) group by cls)
select round(avg(case when pos > 0 then 2 * tp / greatest(called + pos, 1)::double end), 6) as macro_f1, round(2 * sum(tp) / greatest(sum(called) + sum(pos), 1)::double, 6) as micro_f1,
  round(sum(tp) / greatest(sum(called), 1)::double, 6) as micro_p, round(sum(tp) / greatest(sum(pos), 1)::double, 6) as micro_r from per""",
    "bag_scores": f"with {PREDS} select uid, max(p) as score from preds group by uid",
    "bag_screening": f"""with {SCREENING}, {_ROC},
r as (select threat, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2e0 as rk from screening)
select (select sum(threat)::bigint from screening) as n_threat, (select sum(1 - threat)::bigint from screening) as n_clean,
  round((sum(case when threat = 1 then rk end) - sum(threat) * (sum(threat) + 1) / 2e0) / nullif(sum(threat) * sum(1 - threat), 0), 6) as auroc,
  round({_TPR.format(f='0.05e0')}, 6) as tpr_at_fpr_5, round({_TPR.format(f='0.01e0')}, 6) as tpr_at_fpr_1,
  round({_CLEAR.format(r='0.95')}, 6) as clear_at_rec_95, round({_CLEAR.format(r='0.99')}, 6) as clear_at_rec_99 from r""",
    "roc_points": f"with {SCREENING}, {_ROC} select score, round(fpr, 6) as fpr, round(tpr, 6) as tpr from pt",
    "recall_clearance": f"""with {SCREENING}, thr as (select distinct unnest(quantile_cont(score, [{', '.join(f'{i / 20}' for i in range(21))}])) as thr from screening where threat = 1)
select round(thr, 6) as thr, round(avg(case when threat = 1 then (score >= thr)::int end), 6) as recall, round(avg(case when threat = 0 then (score < thr)::int end), 6) as clearance from screening, thr group by thr""",
    "confusion": f"with {PREDS}, {_CONF} select actual, called, n, round(n / (sum(n) over (partition by actual))::double, 6) as share from conf",
    "lookalike_groups": f"""with {PREDS}, {_CONF}
select a.lookalike as grp, sum(n)::bigint as scans, sum(case when actual = called then n else 0 end)::bigint as correct,
  sum(case when actual <> called and b.lookalike = a.lookalike then n else 0 end)::bigint as confused_within
from conf join class_names a on a.class_id = actual left join class_names b on b.class_id = called where a.lookalike is not null group by a.lookalike""",
    "tercile_edges": "select round(quantile_cont(l_extendedprice, 1e0 / 3), 6) as lo, round(quantile_cont(l_extendedprice, 2e0 / 3), 6) as hi from lineitem",
    "box_strata": f"""with {BOXES}, v as (select uid, cls, (x2 - x1) * (y2 - y1) as value from gt),
e as (select quantile_cont(value, 1e0 / 3) as lo, quantile_cont(value, 2e0 / 3) as hi from v)
select uid, cls, (max(value) >= lo)::int + (max(value) >= hi)::int as stratum from v, e group by uid, cls, lo, hi""",
    "stratified_ap": f"""with {PREDS}, v as (select vec_id as uid, label as cls, embedding[1]::double as value from embeddings),
e as (select quantile_cont(value, 1e0 / 3) as lo, quantile_cont(value, 2e0 / 3) as hi from v),
st as (select uid, cls, (max(value) >= lo)::int + (max(value) >= hi)::int as stratum from v, e group by uid, cls, lo, hi),
x as (select st.stratum, p.cls, p.y, p.p from preds p join st using (uid, cls) where y = 1 union all select a.stratum, p.cls, y, p from preds p, (select distinct stratum from st) a where y = 0),
{_AP.format(by='stratum, cls', w='1', rows='x')}
select stratum, round(avg(ap), 6) as map, sum(positives)::bigint as positives, count(*) as classes from ap where positives >= 3 group by stratum""",
    "bootstrap_map_ci": f"{_BOOT} select model, round(quantile_cont(map, 0.025), 6) as lo, round(quantile_cont(map, 0.975), 6) as hi from maps group by model",
    "paired_delta": f"{_BOOT}, d as (select y.map - x.map as d from maps x join maps y using (b) where x.model = 'a' and y.model = 'b') select round(quantile_cont(d, 0.025), 6) as delta_lo, round(quantile_cont(d, 0.975), 6) as delta_hi, round(avg((d <= 0)::int), 6) as worse from d",
    "auroc_ci": f"""with {SCREENING}, {_REP.format(rows='screening', n=N_BOOT, w=_W)},
s as (select b, score, sum(w * threat) as tp, sum(w * (1 - threat)) as fp from rep group by all),
c as (select *, coalesce(sum(fp) over (partition by b order by score rows between unbounded preceding and 1 preceding), 0) as below from s),
a as (select b, sum(tp * (below + fp / 2e0)) / nullif(sum(tp) * sum(fp), 0) as auroc from c group by b)
select round(quantile_cont(auroc, 0.025), 6) as lo, round(quantile_cont(auroc, 0.975), 6) as hi from a""",
}
