"""Queries for ingest, splits, summaries, result tables, colours and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baglight.functions import geometry as G, labels as L
from baglight.operators import anomaly, experiments, ingest, material, nested, splits
from baglight.plans.bindings import BOXES, INDEX, PREDS, SCANS, gt_boxes, index, preds, scans
from baglight.plans.recognition import rounded
from baglight.sources.tables import table

BITS = 12
DRESS = [("  CLASS 4_", " "), ("class-22: ", ""), ("3D ", ""), ("ied-", ""), ("my old ", " no. 2"), ("__", "!!")]
NUMBERED = ["", "class ", "Class_0", "CLASS-2", "2"]
WORDS = ["knife", "clutter", "rucksack", "x-ray", "hidden"]


def sigs(s: SparkSession, d: str) -> DataFrame:
    return splits.signatures(scans(s, d, "sig_d", "sig_a"))


def _leakage(s: SparkSession, d: str) -> DataFrame:
    r = scans(s, d, "part", "sig_d", "sig_a")
    return splits.leakage(splits.signatures(r.filter("part in ('val', 'test')")), splits.signatures(r.filter("part = 'train'")), BITS)


def _vocabulary(s: SparkSession, d: str) -> DataFrame:
    return ingest.label_counts(nested.nested_table(table(s, d, "annotation_files", "file_id", "payload", "read_at"), "object"), "label")


def _spellings(s: SparkSession, d: str) -> DataFrame:
    """Names of folders, and of classes in several dresses."""
    c = table(s, d, "class_names", "class_id", "class_name")
    dressed = [F.col("class_name"), *[F.concat(F.lit(a), "class_name", F.lit(b)) for a, b in DRESS], *[F.concat(F.lit(a), F.col("class_id").cast("string")) for a in NUMBERED]]
    names = index(s, d, "folder_name").select(F.col("folder_name").alias("raw"))
    return names.union(c.select(F.explode(F.array(*dressed)).alias("raw"))).distinct()


def _box_vote(s: SparkSession, d: str) -> DataFrame:
    """Corner and size of every box, beside its bounds."""
    b = gt_boxes(s, d)
    return ingest.box_layout(b.select(F.col("x1").alias("v1"), F.col("y1").alias("v2"), (F.col("x2") - F.col("x1")).alias("v3"), (F.col("y2") - F.col("y1")).alias("v4"), "x1", "y1", "x2", "y2"))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    sized = index(s, d, "img_w", "img_h").filter("img_w > 0 and img_h > 0").select("uid", "img_w", "img_h")
    b = gt_boxes(s, d).join(sized, "uid")
    v = [F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")]
    return b.select("uid", "k", G.resolve_box(v, "xywh", F.col("img_w"), F.col("img_h")).alias("b")).filter("b is not null").select("uid", "k", "b.*")


def _stems(s: SparkSession, d: str) -> DataFrame:
    r = index(s, d, "folder_id", "img_path", "seg_path")
    left = r.select("uid", "folder_id", L.stem_key(F.col("img_path")).alias("stem"))
    right = r.filter("seg_path is not null").select("folder_id", L.stem_key(F.col("seg_path")).alias("stem"), "seg_path")
    return ingest.by_stem(left.filter("stem is not null"), right, ["folder_id", "stem"], "seg_path").select("uid", "seg_path")


def _found(s: SparkSession, d: str) -> DataFrame:
    r = index(s, d, "folder_id", "boxes")
    made = ingest.folder_rules(r.select("uid", "folder_id", F.transform("boxes", lambda b: b["cls"]).alias("found")))
    return made.select("uid", F.concat_ws(",", F.transform("labels", lambda c: c.cast("string"))).alias("labels"), "issue")


def _pixels(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    c = material.hsv(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12.5)
    return p.select("l_orderkey", "l_linenumber", c.alias("c")).select("l_orderkey", "l_linenumber", "c.*")


def _loss(s: SparkSession, d: str, loss) -> DataFrame:
    return preds(s, d).groupBy("cls").agg((F.sum(loss(F.col("y"), F.col("p"))) / F.countDistinct("uid")).alias("loss"))


def _runs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = table(s, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    old = n.select(F.col("n_name").alias("run"), F.col("n_nationkey").cast("double").alias("map"))
    new = n.filter("n_regionkey = 2").select(F.col("n_name").alias("run"), (F.col("n_nationkey") * 10).cast("double").alias("map"), F.col("n_regionkey").alias("extra"))
    return old, new


def _configs(s: SparkSession, d: str) -> DataFrame:
    n, r = table(s, d, "nation", "n_nationkey", "n_regionkey"), table(s, d, "supplier", "s_suppkey", "s_nationkey")
    a = n.select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    b = r.groupBy(F.col("s_nationkey").alias("key")).agg((F.min("s_suppkey") % 5).cast("string").alias("value"))
    return experiments.config_diff(a, b)


def _dag(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation", "n_nationkey")
    specs = n.select(F.col("n_nationkey").alias("name"), (F.col("n_nationkey") + 1).alias("minutes"))
    deps = n.filter("n_nationkey > 0").select(F.col("n_nationkey").alias("name"), F.floor(F.col("n_nationkey") / 2).alias("dep"))
    more = n.filter("n_nationkey > 2").select(F.col("n_nationkey").alias("name"), (F.col("n_nationkey") - 3).alias("dep"))
    return experiments.estimates(specs, deps.union(more))


def _zero_shot(s: SparkSession, d: str) -> DataFrame:
    """Cosine of each embedding with each class's mean, as shares."""
    emb = table(s, d, "embeddings", "vec_id", "embedding", "label")
    mean = emb.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centre = mean.groupBy(F.col("label").alias("cls")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x.m).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    cos = dot("embedding", "c") / (F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("c", "c")))
    j = emb.crossJoin(F.broadcast(centre)).select(F.col("vec_id").alias("uid"), "cls", (cos * 10).alias("v"))
    return material.softmax(j, "uid", "v").select("uid", "cls", "share")


def _yolo(s: SparkSession, d: str) -> DataFrame:
    from baglight.sources.annotations import yolo_lines

    sized = index(s, d, "img_w", "img_h").filter("img_w > 0 and img_h > 0").select("uid", "img_w", "img_h")
    return yolo_lines(gt_boxes(s, d).join(sized, "uid"))


QUERIES = {
    "near_dup_pairs": lambda s, d: splits.near_duplicates(sigs(s, d), BITS),
    "dup_groups": lambda s, d: splits.duplicate_groups(sigs(s, d), BITS)[0],
    "leakage_audit": _leakage,
    "split_report": lambda s, d: splits.split_report(scans(s, d, "part", "labels")),
    "split_class_report": lambda s, d: splits.class_report(scans(s, d, "part", "labels"), 20),
    "part_select": lambda s, d: splits.select_part(scans(s, d, "part", "cache_ok", "labels"), "train", [8, 11]).select("uid"),
    "train_subset": lambda s, d: splits.subset(scans(s, d, "part", "labels").filter("part = 'train'").select("uid", "labels"), 0.4).select("uid"),
    "grouped_split": lambda s, d: splits.grouped_split(scans(s, d, "dup_group", "labels").select("uid", F.when(F.col("dup_group") >= 0, F.col("dup_group").cast("string")).otherwise(F.col("uid")).alias("group"), "labels"), 0.15),
    "label_vocab": _vocabulary,
    "label_spellings": lambda s, d: _spellings(s, d).select("raw", L.label_class(F.col("raw")).alias("m")).select("raw", "m.cls", "m.status"),
    "bbox_vote": lambda s, d: rounded(_box_vote(s, d)),
    "resolve_box": lambda s, d: rounded(_resolved(s, d)),
    "folder_rules": _found,
    "folder_parse": lambda s, d: index(s, d, "folder_name").select("uid", L.folder_class(F.col("folder_name")).alias("c")).select("uid", "c.*"),
    "label_matrix": lambda s, d: ingest.label_matrix(index(s, d, "labels"), 20).select("uid", F.concat_ws("", F.transform("row", lambda x: x.cast("string"))).alias("row")),
    "stem_lookup": _stems,
    "safe_uids": lambda s, d: ingest.safe_uids(table(s, d, "customer", "c_custkey", "c_mktsegment").select(L.safe_name(F.col("c_mktsegment")).alias("name"), "c_custkey"), "name", "c_custkey").select("c_custkey", "uid"),
    "caption_strata": lambda s, d: index(s, d, "caption").select("uid", L.clutter_level(F.col("caption")).alias("level")).groupBy("level").agg(F.count("*").alias("n")),
    "caption_words": lambda s, d: rounded(ingest.word_shares(index(s, d, "caption"), "caption", WORDS)),
    "split_eda": lambda s, d: rounded(ingest.overview(index(s, d, "split", "n_labels"))),
    "class_ratio": lambda s, d: rounded(ingest.class_ratio(index(s, d, "split", "labels"))),
    "bag_frac_summary": lambda s, d: rounded(ingest.describe(scans(s, d, "bag_frac"), "bag_frac")),
    "bag_frac_histogram": lambda s, d: ingest.histogram(scans(s, d, "bag_frac"), "bag_frac", 40),
    "group_sizes": lambda s, d: rounded(ingest.describe(scans(s, d, "dup_group").filter("dup_group >= 0").groupBy("dup_group").agg(F.count("*").alias("n")), "n")),
    "mask_sources": lambda s, d: index(s, d, "mask_source", "label_source").groupBy("label_source", "mask_source").agg(F.count("*").alias("n")),
    "subsample": lambda s, d: anomaly.random_subsample(table(s, d, "orders", "o_orderkey"), "o_orderkey", 100),
    "upsert": lambda s, d: experiments.upsert(*_runs(s, d)),
    "reset": lambda s, d: experiments.without_runs(_runs(s, d)[0], "FRANCE", "UNITED"),
    "headline": lambda s, d: experiments.headline(list(_runs(s, d)), "map").select("run", "map", "place"),
    "config_diff": _configs,
    "dag_estimate": _dag,
    "seed_summary": lambda s, d: rounded(experiments.seed_summary(table(s, d, "customer", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal")),
    "speed_factor": lambda s, d: rounded(experiments.speed(table(s, d, "lineitem", "l_quantity", "l_tax").select((F.col("l_quantity") * F.col("l_tax")).alias("actual"), F.col("l_quantity").alias("estimated")))),
    "durations": lambda s, d: table(s, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", L.duration(F.col("o_totalprice") / 10).alias("took")),
    "pixel_hsv": lambda s, d: rounded(_pixels(s, d)),
    "hue_histogram": lambda s, d: rounded(material.hue_histogram(_pixels(s, d))),
    "material_share": lambda s, d: rounded(_pixels(s, d).select("l_orderkey", "l_linenumber", material.membership(F.col("h"), F.col("s"), 0.08, 0.05).alias("organic"))),
    "asl_loss": lambda s, d: rounded(_loss(s, d, material.asymmetric_loss)),
    "focal_loss": lambda s, d: rounded(_loss(s, d, material.focal_loss)),
    "cb_weights": lambda s, d: rounded(material.balanced_weights(gt_boxes(s, d).groupBy("cls").agg(F.count("*").alias("n")))),
    "clip_softmax": lambda s, d: rounded(_zero_shot(s, d), 5),
    "yolo_lines": _yolo,
}

_SIG = SCANS + ",\nsig as (select uid, part, sig_d as d, sig_a as a from scans where sig_d is not null and sig_a is not null and not (sig_d = 0 and sig_a = 0))"
_REPS = _SIG + f""",
reps as (select d, a, min(uid) as rep from sig group by d, a),
pairs as (select x.rep as a, y.rep as b, bit_count(xor(x.d, y.d)) + bit_count(xor(x.a, y.a)) as distance from reps x join reps y on x.rep < y.rep
  and bit_count(xor(x.d, y.d)) + bit_count(xor(x.a, y.a)) <= {BITS})"""
_PIX = """
raw as (select l_orderkey, l_linenumber, l_quantity / 50 as r, l_discount * 10 as g, l_tax * 12.5e0 as b from lineitem),
px as (select *, greatest(r, g, b) as top, greatest(r, g, b) - least(r, g, b) as d from raw),
hs as (select l_orderkey, l_linenumber, case when r = top then (g - b) / (d + 1e-6) when g = top then 2 + (b - r) / (d + 1e-6) else 4 + (r - g) / (d + 1e-6) end / 6 as h0, d / (top + 1e-6) as s, top as v from px),
hsv as (select l_orderkey, l_linenumber, h0 - floor(h0) as h, s, v from hs)"""
_RUNS = """
old as (select n_name as run, n_nationkey::double as map from nation),
new as (select n_name as run, n_nationkey::double * 10 as map, n_regionkey as extra from nation where n_regionkey = 2)"""
_STEM = r"regexp_replace(regexp_replace(lower(list_last(string_split(replace({c}, chr(92), '/'), '/'))), '\.[^.]*$', ''), '(_mask|-mask|_seg|-seg|_gt|_label|_segmentation|_bb|_bbox)$', '')"
_D = "round(avg({v}), 6) as mean, round(stddev_samp({v}), 6) as std, {m1} as least, round(quantile_cont({v}, 0.25), 6) as q25, round(quantile_cont({v}, 0.5), 6) as median, round(quantile_cont({v}, 0.75), 6) as q75, {m2} as most"

_WORDS = "(values " + ", ".join(f"('{k}', {v}, {i})" for i, (k, v) in enumerate(L.SYNONYMS.items())) + ") as w(k, cls, i)"
_RAW = "select distinct folder_name as raw from idx union select class_name from class_names" + "".join(f" union select '{a}' || class_name || '{b}' from class_names" for a, b in DRESS) + "".join(f" union select '{a}' || class_id from class_names" for a in NUMBERED)

ORACLES = {
    "label_spellings": f"""with {INDEX}, r as ({_RAW}), s as (select raw, trim(lower(raw)) as s from r),
h as (select raw, s, regexp_extract(s, '^class[ _-]*([0-9]+)[ _:.-]*(.*)$', 1) as n, regexp_extract(s, '^class[ _-]*([0-9]+)[ _:.-]*(.*)$', 2) as t from s),
k as (select raw, n <> '' and t = '' as alone, n, regexp_replace(case when n <> '' then t else s end, '[^a-z0-9]', '', 'g') as k from h),
v as (select *, case when alone then n::bigint when regexp_matches(k, '^[0-9]+$') then k::bigint end as v, (select w.cls from {_WORDS} where w.k = k.k) as same,
  (select w.cls from {_WORDS} where len(w.k) >= 4 and contains(k.k, w.k) order by len(w.k) desc, w.i limit 1) as inner_cls from k),
j as (select raw, case when not alone and k in {L.IGNORED} then {{'c': -1, 's': 'ignore'}} when not alone and k in {L.GENERIC} then {{'c': -1, 's': 'generic'}} when not alone and same is not null then {{'c': same, 's': 'ok'}}
  when v between 1 and 20 then {{'c': v - 1, 's': 'numeric'}} when alone and v = 22 then {{'c': -1, 's': 'ignore'}} when v is not null then {{'c': -1, 's': 'unmapped'}}
  when starts_with(k, '3d') or contains(k, '3dprint') or contains(k, 'printedgun') then {{'c': 2, 's': 'fuzzy'}} when starts_with(k, 'ied') or contains(k, 'explos') or contains(k, 'bomb') then {{'c': 0, 's': 'fuzzy'}}
  when inner_cls is not null then {{'c': inner_cls, 's': 'fuzzy'}} else {{'c': -1, 's': 'unmapped'}} end as m from v)
select raw, m.c::int as cls, m.s as status from j where raw is not null""",
    "near_dup_pairs": f"with {_REPS} select * from pairs",
    "leakage_audit": f"""with {_SIG} select e.uid, min(bit_count(xor(e.d, t.d)) + bit_count(xor(e.a, t.a))) as distance from sig e, sig t
where e.part in ('val', 'test') and t.part = 'train' and bit_count(xor(e.d, t.d)) + bit_count(xor(e.a, t.a)) <= {BITS} group by e.uid""",
    "dup_groups": f"""with recursive {_REPS},
of as (select d, a, min(uid) as rep, count(*) as scans from sig group by d, a), bits as (select unnest(range({BITS} + 1)) as t),
way as (select t, a, b from pairs, bits where distance <= t union all select t, b, a from pairs, bits where distance <= t),
reach(t, n, r) as (select t, rep, rep from of, bits union select reach.t, way.b, reach.r from reach join way on way.t = reach.t and way.a = reach.n),
comp as (select t, n as rep, min(r) as g from reach group by t, n),
largest as (select t, max(s) as s from (select t, g, sum(scans) as s from comp join of using (rep) group by t, g) group by t),
pick as (select coalesce(max(t) filter (s <= greatest(10, 0.02 * (select count(*) from sig))), 0) as t from largest)
select sig.uid, comp.g as "group" from sig join of using (d, a) join comp using (rep) join pick using (t)""",
    "split_report": f"""with {SCANS}, n as (select part, coalesce(len(list_distinct(labels)) + (list_contains(list_transform(labels, lambda x: x is null), true))::int, 0) as n from scans)
select part, count(*) as scans, sum((n > 0)::int)::bigint as threat, sum((n = 0)::int)::bigint as clean, sum((n > 1)::int)::bigint as multi from n group by part""",
    "split_class_report": f"""with {SCANS}, l as (select distinct part, uid, unnest(labels) as cls from scans), g as (select part, c as cls from (select distinct part from scans), (select unnest(range(20)) as c))
select g.part, g.cls::int as cls, count(l.uid) as positives from g left join l on l.part = g.part and l.cls = g.cls group by all""",
    "train_subset": f"""with {SCANS}, t as (select uid, coalesce(array_to_string(list_sort(list_distinct(labels)), ','), '') as pattern from scans where part = 'train'),
n as (select uid, row_number() over (order by pattern, md5('0:' || uid), uid) as i from t) select uid from n where floor(i * 0.4e0) > floor((i - 1) * 0.4e0)""",
    "grouped_split": f"""with {SCANS}, s as (select uid, case when dup_group >= 0 then dup_group::varchar else uid end as grp, labels from scans),
l as (select distinct uid, grp, coalesce(label, -1) as label from (select uid, grp, unnest(case when labels is null or len(labels) = 0 then [null] else labels end) as label from s)),
r as (select label, count(*) as n from l group by label), rare as (select grp, arg_min(label, (n, label)) as label from l join r using (label) group by grp),
g as (select grp, count(*) as n, any_value(label) as label from s join rare using (grp) group by grp),
o as (select *, row_number() over (order by -floor(log2(n)), label, md5('0:' || grp), grp) as i from g),
side as (select grp, case when floor(i * 0.15e0 + 0.5e0) > floor((i - 1) * 0.15e0 + 0.5e0) and n <= 0.15e0 * (select count(*) from s) then 'val' else 'train' end as side from o)
select uid, side from s join side using (grp)""",
    "part_select": f"with {SCANS} select uid from scans where part = 'train' and cache_ok and not coalesce(list_has_any(labels, [8, 11]), false)",
    "bbox_vote": f"with {BOXES} select 'xywh' as layout, count(*) as n, sum((x2 - x1 < x1 or y2 - y1 < y1)::int)::bigint as wrong_order, "
    + "round(avg({a}), 6) as iou_xyxy, 1e0 as iou_xywh from gt".format(
        a="(greatest(0, least(x2 - x1, x2) - greatest(x1, x1)) * greatest(0, least(y2 - y1, y2) - greatest(y1, y1))) / greatest((x2 - x1 - x1) * (y2 - y1 - y1) + (x2 - x1) * (y2 - y1) - (greatest(0, least(x2 - x1, x2) - x1) * greatest(0, least(y2 - y1, y2) - y1)), 1e-6)"
    ),
    "resolve_box": f"""with {BOXES}, j as (select uid, k, x1 as a, y1 as b, x2 - x1 as c, y2 - y1 as e, img_w as w, img_h as h from gt join idx using (uid) where img_w > 0 and img_h > 0),
n as (select uid, k, w, h, case when greatest(abs(a), abs(b), abs(c), abs(e)) <= 1.5 then a * w else a end as a, case when greatest(abs(a), abs(b), abs(c), abs(e)) <= 1.5 then b * h else b end as b,
  case when greatest(abs(a), abs(b), abs(c), abs(e)) <= 1.5 then c * w else c end as c, case when greatest(abs(a), abs(b), abs(c), abs(e)) <= 1.5 then e * h else e end as e from j),
x as (select uid, k, least(greatest(least(a, a + c), 0), w) as x1, least(greatest(least(b, b + e), 0), h) as y1, least(greatest(greatest(a, a + c), 0), w) as x2, least(greatest(greatest(b, b + e), 0), h) as y2 from n)
select uid, k, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2 from x where x2 - x1 >= 1 and y2 - y1 >= 1""",
    "folder_rules": f"""with {INDEX}, f as (select uid, folder_id, list_sort(list_distinct(list_filter(list_transform(coalesce(boxes, []), lambda b: b.cls), lambda c: c >= 0))) as found from idx)
select uid, array_to_string(case when folder_id = 22 then [] when folder_id = 21 then found else [folder_id - 1] end, ',') as labels,
  case when folder_id = 22 and len(found) > 0 then 'benign_with_objects' when folder_id < 21 and len(list_filter(found, lambda c: c <> folder_id - 1)) > 0 then 'label_conflict'
    when folder_id = 21 and len(found) = 0 then 'no_objects' else '' end as issue from f""",
    "folder_parse": f"""with {INDEX} select uid, try_cast(nullif(regexp_extract(folder_name, '(?i)^\\s*class[\\s_-]*(\\d+)[\\s_.-]*(.*?)\\s*$', 1), '') as int) as id,
  regexp_extract(folder_name, '(?i)^\\s*class[\\s_-]*(\\d+)[\\s_.-]*(.*?)\\s*$', 2) as label from idx""",
    "label_matrix": f"with {INDEX} select uid, array_to_string(list_transform(range(20), lambda c: coalesce(list_contains(labels, c::int), false)::int), '') as row from idx",
    "stem_lookup": f"""with {INDEX}, l as (select uid, folder_id, {_STEM.format(c='img_path')} as stem from idx where img_path is not null),
r as (select folder_id, {_STEM.format(c='seg_path')} as stem, min(seg_path) as seg_path from idx where seg_path is not null group by all) select uid, r.seg_path from l left join r using (folder_id, stem)""",
    "safe_uids": """with n as (select c_custkey, regexp_replace(regexp_replace(c_mktsegment, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') as name from customer),
o as (select c_custkey, case when name = '' then 'x' else name end as name from n), k as (select *, row_number() over (partition by name order by c_custkey) as i from o)
select c_custkey, case when i = 1 then name else name || '_' || i end as uid from k""",
    "caption_strata": f"""with {INDEX}, w as (select lower(coalesce(nullif(regexp_extract(caption, '(?i)\\b(limited|light|low|minimal|medium|moderate|heavy|heavily|high|extreme|extremely)\\b[\\w\\s-]{{0,15}}clutter', 1), ''), '')) as w from idx)
select case when w in ('limited', 'light', 'low', 'minimal') then 0 when w in ('medium', 'moderate') then 1 when w in ('heavy', 'heavily', 'high') then 2 when w in ('extreme', 'extremely') then 3 else -1 end as level, count(*) as n from w group by level""",
    "caption_words": f"with {INDEX} select w as word, round(avg(contains(lower(coalesce(caption, '')), w)::int), 6) as share from idx, (select unnest({WORDS}) as w) group by w",
    "split_eda": f"""with {INDEX}, n as (select split, coalesce(n_labels, 0) as n from idx) select split, count(*) as scans, sum((n > 0)::int)::bigint as threat, sum((n > 1)::int)::bigint as multi, sum((n = 0)::int)::bigint as clean,
  round(sum((n = 0)::int) * 100 / count(*)::double, 6) as clean_pct from n group by split""",
    "class_ratio": f"""with {INDEX}, l as (select distinct split, uid, unnest(labels) as cls from idx), g as (select cls, sum((split = 'train')::int)::bigint as train, sum((split = 'test')::int)::bigint as test from l where cls is not null group by cls)
select cls, train, test, round(test / nullif(train, 0)::double, 6) as ratio from g""",
    "bag_frac_summary": f"with {SCANS} select count(bag_frac) as n, {_D.format(v='bag_frac', m1='round(min(bag_frac), 6)', m2='round(max(bag_frac), 6)')} from scans",
    "bag_frac_histogram": f"""with {SCANS}, e as (select min(bag_frac) as lo, max(bag_frac) as hi from scans)
select least(floor((bag_frac - lo) / (hi - lo) * 40), 39)::int as bin, count(*) as n from scans, e where bag_frac is not null group by bin""",
    "group_sizes": f"with {SCANS}, g as (select dup_group, count(*) as n from scans where dup_group >= 0 group by dup_group) select count(*) as n, {_D.format(v='n', m1='min(n)', m2='max(n)')} from g".replace("select count(*) as n, round(avg(n)", "select count(g.n) as n, round(avg(g.n)"),
    "mask_sources": f"with {INDEX} select label_source, mask_source, count(*) as n from idx group by all",
    "subsample": "select o_orderkey from orders order by md5('0:' || o_orderkey), o_orderkey limit 100",
    "upsert": f"with {_RUNS} select run, map, null::int as extra from old where run not in (select run from new) union all select run, map, extra from new",
    "reset": f"with {_RUNS} select * from old where run <> 'FRANCE' and not starts_with(run, 'UNITED')",
    "headline": f"with {_RUNS}, a as (select run, coalesce(n.map, o.map) as map from old o left join new n using (run)) select run, map, (select count(*) + 1 from a b where b.map > a.map)::int as place from a",
    "config_diff": """with a as (select n_nationkey as key, n_regionkey::varchar as value from nation), b as (select s_nationkey as key, (min(s_suppkey) % 5)::varchar as value from supplier group by all)
select coalesce(a.key, b.key) as key, a.value as a, b.value as b from a full outer join b on a.key = b.key where a.value is distinct from b.value or a.key is null or b.key is null""",
    "dag_estimate": """with recursive dep as (select n_nationkey as name, n_nationkey // 2 as dep from nation where n_nationkey > 0 union select n_nationkey, n_nationkey - 3 from nation where n_nationkey > 2),
need as (select * from dep union select need.name, dep.dep from need join dep on dep.name = need.dep)
select n_nationkey as name, (n_nationkey + 1 + coalesce((select sum(dep + 1) from need where need.name = n_nationkey and need.dep <> n_nationkey), 0))::bigint as minutes from nation""",
    "seed_summary": "select c_nationkey, round(avg(c_acctbal), 6) as mean, round(stddev_samp(c_acctbal), 6) as std, count(c_acctbal) as n from customer group by c_nationkey",
    "speed_factor": "select round(least(greatest(median(l_quantity * l_tax / nullif(l_quantity, 0)), 0.3), 3), 6) as factor from lineitem",
    "durations": """with s as (select o_orderkey, floor(o_totalprice / 10)::bigint as s from orders)
select o_orderkey, case when s >= 3600 then (s // 3600) || 'h' || lpad(((s % 3600) // 60)::varchar, 2, '0') || 'm' else (s // 60) || 'm' || lpad((s % 60)::varchar, 2, '0') || 's' end as took from s""",
    "pixel_hsv": f"with {_PIX} select l_orderkey, l_linenumber, round(h, 6) as h, round(s, 6) as s, round(v, 6) as v from hsv",
    "hue_histogram": f"with {_PIX}, c as (select least(floor(h * 72), 71)::int as bin, count(*) as n from hsv where s > 0.25 and v > 0.15 group by bin) select bin, round(n / (sum(n) over ())::double, 6) as share from c",
    "material_share": f"with {_PIX} select l_orderkey, l_linenumber, round(exp(-0.5e0 * pow(least(abs(h - 0.08e0), 1 - abs(h - 0.08e0)) / 0.05e0, 2)) * least(s / 0.15e0, 1), 6) as organic from hsv",
    "asl_loss": f"""with {PREDS}, q as (select cls, uid, y, p, least(1 - p + 0.05e0, 1) as q from preds)
select cls, round(sum(-(y * ln(greatest(p, 1e-8)) + (1 - y) * pow(1 - q, 4) * ln(greatest(q, 1e-8)))) / count(distinct uid), 6) as loss from q group by cls""",
    "focal_loss": f"with {PREDS}, q as (select cls, uid, case when y = 1 then p else 1 - p end as r from preds) select cls, round(sum(-pow(1 - r, 2) * ln(greatest(r, 1e-8))) / count(distinct uid), 6) as loss from q group by cls",
    "cb_weights": f"with {BOXES}, c as (select cls, (1 - 0.999e0) / (1 - pow(0.999e0, count(*))) as w from gt group by cls) select cls, round(w / avg(w) over (), 6) as weight from c",
    "clip_softmax": """with val as (select vec_id, label, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings), cen as (select label as cls, i, avg(v) as m from val group by all),
c as (select vec_id as uid, cls, sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))) * 10 as v from val join cen using (i) group by all)
select uid, cls, round(exp(v - max(v) over (partition by uid)) / sum(exp(v)) over (partition by uid) * exp(max(v) over (partition by uid)), 5) as share from c""",
    "yolo_lines": f"""with {BOXES}, j as (select uid, k, cls, (x1 + x2) / 2 / img_w as cx, (y1 + y2) / 2 / img_h as cy, (x2 - x1) / img_w as w, (y2 - y1) / img_h as h from gt join idx using (uid) where img_w > 0 and img_h > 0)
select uid, string_agg(printf('%d %.6f %.6f %.6f %.6f', cls, round(cx, 6), round(cy, 6), round(w, 6), round(h, 6)), chr(10) order by k) as text from j group by uid""",
}
