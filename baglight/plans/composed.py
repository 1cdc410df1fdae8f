"""Queries for patch tables and whole evaluations, tuned on one part and used on another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baglight.functions import labels as L
from baglight.operators import evaluation as E, patches, patchsets as P, recognition as R, splits
from baglight.plans.bindings import BOXES, INDEX, PREDS, SCANS, det_boxes, gt_boxes, index, preds, scans
from baglight.plans.localisation import CELLS, CROPS, HELD_OUT, _IOA, _fused, cells
from baglight.plans.patchwork import _BACKGROUND, _states
from baglight.plans.recognition import _AP, _BEST, rounded
from baglight.sources.tables import table


def _parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two of five rows by number as val, the rest as test."""
    return df.filter("uid % 5 < 2"), df.filter("uid % 5 >= 2")


def _background(s: SparkSession, d: str) -> DataFrame:
    sized = index(s, d, "img_w", "img_h").filter("img_w > 64 and img_h > 64").select("uid", F.col("img_w").alias("w"), F.col("img_h").alias("h"))
    return patches.background_boxes(sized, gt_boxes(s, d), 3, [32, 48, 64])


def _train_patches(s: SparkSession, d: str) -> DataFrame:
    return P.train_patches(gt_boxes(s, d), _background(s, d), det_boxes(s, d))


def _patch_boxes(s: SparkSession, d: str) -> DataFrame:
    return P.patch_boxes(_train_patches(s, d), gt_boxes(s, d))


def _kinds(s: SparkSession, d: str) -> DataFrame:
    return P.kind_counts(_train_patches(s, d).join(index(s, d, "split").select("uid", "split"), "uid"), "split")


def _strata(s: SparkSession, d: str) -> DataFrame:
    """Strata of the embedding's first value: edges and thresholds of val, on test."""
    val, test = _parts(preds(s, d))
    emb = table(s, d, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("uid"), F.col("label").alias("cls"), F.col("embedding")[0].cast("double").alias("value"))
    ev, et = _parts(emb)
    return E.stratified_report(test, R.pair_strata(et, R.terciles(ev, "value")), R.thresholds(val))


def _agreement(s: SparkSession, d: str) -> DataFrame:
    """Each embedding's cells as its mask, and a box by its label."""
    c = cells(s, d)
    boxes = c.select("uid").distinct().select("uid", *[(F.col("uid") % m * 1.3).alias(n) for n, m in (("x1", 4), ("y1", 3))], *[(F.col("uid") % m + 3.4).alias(n) for n, m in (("x2", 5), ("y2", 4))])
    return P.mask_agreement(c, boxes, 8, 8)


def _grown(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("uid"), F.col("embedding").cast("array<double>").alias("v"))
    return m.select("uid", F.posexplode(E.upsampled(F.col("v"), 8, 8, 12, 16)).alias("i", "v"))


def _progress(s: SparkSession, d: str) -> DataFrame:
    states = _states(s, d)
    return E.progress(states, states.select("name", (F.col("name").cast("long") + 1).alias("minutes")), F.col("name").cast("long") % 7 == 0)


QUERIES = {
    "train_patches": lambda s, d: rounded(_train_patches(s, d)),
    "eval_patches": lambda s, d: rounded(P.eval_patches(det_boxes(s, d))),
    "patch_boxes": lambda s, d: rounded(_patch_boxes(s, d)),
    "crop_labels": lambda s, d: P.crop_labels(_patch_boxes(s, d), excluded=tuple(HELD_OUT)),
    "patch_kinds": _kinds,
    "patch_classes": lambda s, d: P.classes_per_patch(P.crop_labels(_patch_boxes(s, d))),
    "box_scores": lambda s, d: P.box_scores(det_boxes(s, d)),
    "placement": lambda s, d: rounded(P.placement(cells(s, d))),
    "box_masks": lambda s, d: P.box_cells(gt_boxes(s, d).select("uid", *[(F.col(c) / 40).alias(c) for c in ("x1", "y1", "x2", "y2")]), 32, 32),
    "mask_agreement": lambda s, d: rounded(_agreement(s, d)),
    "agreement_audit": lambda s, d: rounded(P.agreement(_agreement(s, d), "agree")),
    "mask_foreground": lambda s, d: P.foreground(cells(s, d).select("uid", "r", "c", F.round("v", 1).alias("v")), 0.1501),
    "upsample_maps": lambda s, d: rounded(_grown(s, d)),
    "score_evaluation": lambda s, d: rounded(E.evaluate_scores(*_parts(preds(s, d)))),
    "cascade_evaluation": lambda s, d: rounded(E.evaluate_cascade(*_parts(_fused(s, d)))),
    "strata_evaluation": lambda s, d: rounded(_strata(s, d)),
    "bank_evaluation": lambda s, d: rounded(E.evaluate_bank(*_parts(cells(s, d)))),
    "prepared_split": lambda s, d: E.prepare_split(scans(s, d, "split", "cache_ok", "labels", "sig_d", "sig_a")),
    "clutter_strata": lambda s, d: E.caption_strata(index(s, d, "caption"), L.clutter_level(F.col("caption")), 0.01),
    "issue_counts": lambda s, d: E.issue_counts(index(s, d, "issues")),
    "run_progress": _progress,
    "held_out_leaks": lambda s, d: splits.leakage(splits.signatures(scans(s, d, "split", "sig_d", "sig_a").filter("split = 'test'")), splits.signatures(scans(s, d, "split", "sig_d", "sig_a").filter("split = 'train'")), 4),
}

_SQUARE = "(x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, greatest(greatest(x2 - x1, y2 - y1) * 2e0, 96e0) as side"
_CUT = "cx - side / 2 as rx1, cy - side / 2 as ry1, cx + side / 2 as rx2, cy + side / 2 as ry2"
_PATCHES = (
    _BACKGROUND
    + f""",
hard as (select a.* from det a where not exists (select 1 from gt b where b.uid = a.uid and {_IOA} > 0.1) qualify row_number() over (partition by a.uid order by a.k) <= 3),
every as (select uid, 'pos' as kind, k, 1e0 as score, {_SQUARE} from gt union all select uid, 'rand', k, 0e0, {_SQUARE} from rand union all select uid, 'hard', k, score, {_SQUARE} from hard),
patch as (select uid, kind, k, score, {_CUT} from every),
moved as (select p.uid, kind, p.k, g.k as b, cls, (x1 - rx1) * (320 / (rx2 - rx1)) as x1, (y1 - ry1) * (320 / (rx2 - rx1)) as y1, (x2 - rx1) * (320 / (rx2 - rx1)) as x2, (y2 - ry1) * (320 / (rx2 - rx1)) as y2 from patch p join gt g on g.uid = p.uid),
held as (select * from moved where x2 > 0 and y2 > 0 and x1 < 320 and y1 < 320),
lab as (select distinct uid, kind, k, cls from held where greatest(0, least(x2, 264) - greatest(x1, 56)) * greatest(0, least(y2, 264) - greatest(y1, 56)) / greatest((x2 - x1) * (y2 - y1), 1e-6) >= 0.5)"""
)
_VAL = "vals as (select * from preds where uid % 5 < 2), test as (select * from preds where uid % 5 >= 2)"
_TUNED = _BEST.replace("preds", "vals")
_F1 = "round(avg(case when pos > 0 then 2 * tp / greatest(called + pos, 1)::double end), 6) as macro_f1"
_AGREE = f"""with {CELLS}, b as (select distinct uid, greatest(floor((uid % 4) * 1.3e0) - 1, 0) as x1, greatest(floor((uid % 3) * 1.3e0) - 1, 0) as y1, ceil(uid % 5 + 3.4e0) + 1 as x2, ceil(uid % 4 + 3.4e0) + 1 as y2 from cells),
agree as (select uid, sum(case when c >= x1 and c < x2 and r >= y1 and r < y2 then g else 0 end) / nullif(sum(g), 0)::double as agree from cells join b using (uid) group by uid)"""
_GROWN = "select i, {n} as n, least(greatest((i + 0.5e0) * 8 / {n} - 0.5e0, 0), 7) as at from (select unnest(range({n})) as i)"
_AUC = "(select (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * sum(1 - y), 0) from (select {y} as y, rank() over (order by {p}) + (count(*) over (partition by {p}) - 1) / 2e0 as rk from {rows}))"
_PT = """(with s as (select distinct {p} as s from {rows}), q as (select 0e0 as fpr, 0e0 as tpr union all select (select count(*) from {rows} where {y} = 0 and {p} >= s) / nullif((select sum(1 - {y}) from {rows}), 0)::double,
    (select count(*) from {rows} where {y} = 1 and {p} >= s) / nullif((select sum({y}) from {rows}), 0)::double from s),
  m as (select fpr, max(tpr) as hi, min(tpr) as lo from q group by fpr), b as (select fpr, hi from m where fpr <= 0.05e0 order by fpr desc limit 1), a as (select fpr, lo from m where fpr > 0.05e0 order by fpr limit 1)
  select coalesce(b.hi + (0.05e0 - b.fpr) / (a.fpr - b.fpr) * (a.lo - b.hi), b.hi) from b left join a on true)"""
_CUT95 = "(select avg((score < (select score from bag where threat = 1 order by score offset (select least(floor((1 - 0.95e0) * count(*)), count(*) - 1)::bigint from bag where threat = 1) limit 1))::int) from bag where threat = 0)"

ORACLES = {
    "train_patches": f"with {_PATCHES} select uid, kind, k, round(score, 6) as score, round(rx1, 6) as rx1, round(ry1, 6) as ry1, round(rx2, 6) as rx2, round(ry2, 6) as ry2 from patch",
    "eval_patches": f"with {BOXES}, e as (select uid, k, score, {_SQUARE} from det), q as (select uid, k, score, {_CUT} from e) select uid, 'prop' as kind, k, round(score, 6) as score, round(rx1, 6) as rx1, round(ry1, 6) as ry1, round(rx2, 6) as rx2, round(ry2, 6) as ry2 from q",
    "patch_boxes": f"with {_PATCHES} select uid, kind, k, b, cls, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2 from held",
    "crop_labels": f"with {_PATCHES} select * from lab where cls not in ({', '.join(map(str, HELD_OUT))})",
    "patch_kinds": f"with {_PATCHES} select split, sum((kind = 'pos')::int)::bigint as pos, sum((kind = 'rand')::int)::bigint as rand, sum((kind = 'hard')::int)::bigint as hard, 0::bigint as prop from patch join idx using (uid) group by split",
    "patch_classes": f"with {_PATCHES}, n as (select uid, kind, k, count(distinct cls) as classes from lab group by all) select classes, count(*) as patches from n group by classes",
    "box_scores": f"with {BOXES} select uid, cls, max(score) as p from det group by uid, cls",
    "placement": f"with {CELLS}, w as (select uid, r, c, pow(greatest(v, 0), 2) * g as w from cells) select uid, r, c, round(case when sum(w) over p <= 1e-6 then 1e0 / count(*) over p else w / sum(w) over p end, 6) as p from w window p as (partition by uid)",
    "box_masks": f"""with {BOXES}, e as (select uid, round_even(x1 / 40, 0)::int as l, round_even(x2 / 40, 0)::int as m, round_even(y1 / 40, 0)::int as a, round_even(y2 / 40, 0)::int as z from gt)
select distinct uid, r::int as r, c::int as c from e, (select unnest(range(32)) as r), (select unnest(range(32)) as c) where r >= a and r < z and c >= l and c < m""",
    "mask_agreement": f"{_AGREE} select uid, round(agree, 6) as agree from agree",
    "agreement_audit": f"{_AGREE} select count(*) as n, round(median(agree), 6) as median, round(avg((agree < 0.5)::int), 6) as share_low from agree where agree is not null",
    "mask_foreground": f"""with {CELLS}, q as (select uid, r, c, round(v, 1) as v from cells), n as (select uid, v, count(*) as n from q group by uid, v),
m as (select uid, v as often from n qualify row_number() over (partition by uid order by n desc, v) = 1) select uid, r, c, (abs(v - often) > 0.1501e0)::int as g from q join m using (uid)""",
    "upsample_maps": f"""with {CELLS}, y as ({_GROWN.format(n=12)}), x as ({_GROWN.format(n=16)}),
l as (select y.i * 16 + x.i as i, floor(y.at)::int as r0, least(floor(y.at) + 1, 7)::int as r1, y.at - floor(y.at) as fr, floor(x.at)::int as c0, least(floor(x.at) + 1, 7)::int as c1, x.at - floor(x.at) as fc from y, x),
m as (select uid, list(v order by r, c) as v from cells group by uid)
select uid, i::int as i, round((v[r0 * 8 + c0 + 1] * (1 - fc) + v[r0 * 8 + c1 + 1] * fc) * (1 - fr) + (v[r1 * 8 + c0 + 1] * (1 - fc) + v[r1 * 8 + c1 + 1] * fc) * fr, 6) + 0e0 as v from m, l""",
    "score_evaluation": f"""with {PREDS}, {_VAL}, {_TUNED}, {_AP.format(by='grp, cls', w='1', rows="(select uid % 5 < 2 as grp, cls, y, p from preds)")},
per as (select cls, sum(case when p >= thr then y else 0 end) as tp, sum((p >= thr)::int) as called, sum(y) as pos from test join best using (cls) group by cls),
bag as (select uid, max(y) as threat, max(p) as score from test group by uid)
select (select round(avg(ap), 6) from ap where grp) as val_map, (select round(avg(ap), 6) from ap where not grp) as map, {_F1}, round(2 * sum(tp) / greatest(sum(called) + sum(pos), 1)::double, 6) as micro_f1,
  (select sum(threat)::bigint from bag) as bag_n_threat, (select sum(1 - threat)::bigint from bag) as bag_n_clean, round({_AUC.format(y='threat', p='score', rows='bag')}, 6) as bag_auroc,
  case when (select min(threat) from bag) = 0 and (select max(threat) from bag) = 1 then round({_PT.format(y='threat', p='score', rows='bag')}, 6) end as bag_tpr_at_fpr_5, case when (select max(threat) from bag) = 1 then round({_CUT95}, 6) end as bag_clear_at_rec_95 from per""",
    "cascade_evaluation": f"""with {CROPS}, x as (select i, cls, y, case when has then round((i / 10e0) * s1 + (1 - i / 10e0) * s2, 9) else s1 end as p from fused, (select unnest(range(11)) as i) where uid % 5 < 2),
{_AP.format(by='i, cls', w='1', rows='x').replace('step as', 'astep as').replace('from step', 'from astep').replace('cum as', 'acum as').replace('from cum', 'from acum').replace('ap as (', 'aap as (', 1)},
alpha as (select i / 10e0 as a from (select i, round(avg(ap), 9) as map from aap group by i) order by map desc, i limit 1),
r as (select uid, cls, y, 's1' as rule, s1 as p from fused union all select uid, cls, y, 's2', case when has then s2 else 0 end from fused union all select uid, cls, y, 'max', case when has then greatest(s1, s2) else s1 end from fused
  union all select uid, cls, y, 'blend', case when has then round(a * s1 + (1 - a) * s2, 9) else s1 end from fused, alpha),
vals as (select * from r where uid % 5 < 2), test as (select * from r where uid % 5 >= 2), {_TUNED.replace('select cls', 'select rule, cls').replace('group by cls', 'group by rule, cls').replace('partition by cls', 'partition by rule, cls')},
{_AP.format(by='rule, cls', w='1', rows='test')},
per as (select rule, cls, sum(case when p >= thr then y else 0 end) as tp, sum((p >= thr)::int) as called, sum(y) as pos from test join best using (rule, cls) group by rule, cls),
f as (select rule, {_F1} from per group by rule), m as (select rule, round(avg(ap), 6) as map from ap group by rule)
select rule, case when rule = 'blend' then (select a from alpha) end as alpha, map, macro_f1 from m join f using (rule)""",
    "strata_evaluation": f"""with {PREDS}, {_VAL}, {_TUNED}, v as (select vec_id as uid, label as cls, embedding[1]::double as value from embeddings),
e as (select quantile_cont(value, 1e0 / 3) as lo, quantile_cont(value, 2e0 / 3) as hi from v where uid % 5 < 2),
st as (select uid, cls, (max(value) >= lo)::int + (max(value) >= hi)::int as stratum from v, e where uid % 5 >= 2 group by uid, cls, lo, hi),
x as (select st.stratum, p.cls, p.y, p.p from test p join st using (uid, cls) where y = 1 union all select a.stratum, p.cls, y, p from test p, (select distinct stratum from st) a where y = 0),
{_AP.format(by='stratum, cls', w='1', rows='x')}, rec as (select stratum, cls, avg((p >= thr)::int) as recall, count(*) as n from x join best using (cls) where y = 1 group by stratum, cls)
select stratum, round(avg(ap), 6) as map, round(avg(recall), 6) as recall, sum(positives)::bigint as positives from ap join rec using (stratum, cls) where positives >= 3 group by stratum""",
    "bank_evaluation": f"""with {CELLS}, t as (select uid, max(g) as threat, max(v) as most, max(case when g <= 0 then v end) as around from cells group by uid),
n as (select case when threat = 0 then most else around end as x from t where uid % 5 < 2), c as (select median(x) as centre from n),
fit as (select centre, 1.4826e0 * median(abs(x - centre)) as spread, count(x) as n_null from n, c group by centre),
top as (select uid, max(v) as a, avg(v) as b from (select uid, v from cells where uid % 5 >= 2 qualify row_number() over (partition by uid order by v desc) <= 10) group by uid),
bag as (select uid, threat as y, a, b from top join t using (uid)), px as (select g, v from cells join t using (uid) where threat = 1 and uid % 5 >= 2)
select n_null, round(centre, 6) as centre, round(spread, 6) as spread, round({_AUC.format(y='y', p='a', rows='bag')}, 6) as auroc_max, round({_PT.format(y='y', p='a', rows='bag')}, 6) as tpr5_max,
  round({_AUC.format(y='y', p='b', rows='bag')}, 6) as auroc_top, round({_PT.format(y='y', p='b', rows='bag')}, 6) as tpr5_top, round({_AUC.format(y='g', p='v', rows='px')}, 6) as pixel_auroc from fit""",
    "clutter_strata": f"""with {INDEX}, w as (select uid, lower(regexp_extract(caption, '(?i)\\b(limited|light|low|minimal|medium|moderate|heavy|heavily|high|extreme|extremely)\\b[\\w\\s-]{{0,15}}clutter', 1)) as w from idx),
l as (select uid, case when w in ('limited', 'light', 'low', 'minimal') then 0 when w in ('medium', 'moderate') then 1 when w in ('heavy', 'heavily', 'high') then 2 when w in ('extreme', 'extremely') then 3 else -1 end as level from w)
select uid, level from l where level >= 0 and (select avg((level >= 0)::int) from l) > 0.01""",
    "issue_counts": f"with {INDEX}, e as (select distinct uid, trim(unnest(regexp_split_to_array(issues, '[;,]'))) as issue from idx where issues <> '') select issue, count(*) as n from e where issue <> '' group by issue",
    "run_progress": """with s as (select n_nationkey as k, n_regionkey in (0, 1) as done from nation)
select count(*) as runs, sum(done::int)::bigint as done, sum(case when done then 0 else k + 1 end)::bigint as left, sum(case when done or k % 7 = 0 then 0 else k + 1 end)::bigint as core_left from s""",
    "held_out_leaks": f"""with {SCANS}, sig as (select uid, split, sig_d as d, sig_a as a from scans where sig_d is not null and sig_a is not null and not (sig_d = 0 and sig_a = 0))
select e.uid, min(bit_count(xor(e.d, t.d)) + bit_count(xor(e.a, t.a))) as distance from sig e, sig t where e.split = 'test' and t.split = 'train' and bit_count(xor(e.d, t.d)) + bit_count(xor(e.a, t.a)) <= 4 group by e.uid""",
}
