import random
from collections import Counter

import pytest

from baglight.functions import geometry as G
from baglight.functions.labels import duration, folder_class, label_class, safe_name
from baglight.operators import anomaly, detection, experiments, recognition, splits
from pyspark.sql import functions as F


def test_average_precision_groups_ties_and_knows_undefined_classes(spark):
    rows = [(0, 1, 0.9), (0, 0, 0.9), (0, 1, 0.5), (1, 0, 0.4), (2, 1, 0.3), (3, 1, None), (3, 0, 0.2)]
    got = {r.cls: r.ap for r in recognition.average_precision(spark.createDataFrame(rows, "cls int, y int, p double"), ["cls"]).collect()}
    assert got[0] == pytest.approx((1 / 2 + 2 / 3) / 2) and got[1] is None and got[2] is None and got[3] is None
    area = {r.cls: r.auroc for r in recognition.auroc(spark.createDataFrame(rows, "cls int, y int, p double"), ["cls"]).collect()}
    assert area[0] == pytest.approx(0.25) and area[1] is None


def test_ap_does_not_change_with_the_scale_of_scores(spark):
    rng = random.Random(3)
    rows = [(i % 3, int(rng.random() < 0.3), round(rng.random(), 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "cls int, y int, p double")
    a = {r.cls: r.ap for r in recognition.average_precision(df, ["cls"]).collect()}
    b = {r.cls: r.ap for r in recognition.average_precision(df.withColumn("p", F.exp("p") * 7), ["cls"]).collect()}
    assert a == pytest.approx(b)


def test_screening_of_one_class_is_null(spark):
    r = recognition.bag_report(spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.6)], "uid string, threat int, score double")).head()
    assert (r.n_threat, r.n_clean, r.auroc, r.tpr_at_fpr_5) == (2, 0, None, None)


def test_thresholds_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(i % 4, int(rng.random() < 0.4), round(rng.random(), 2)) for i in range(400)] + [(9, 0, 0.5)]
    got = {r.cls: r.thr for r in recognition.thresholds(spark.createDataFrame(rows, "cls int, y int, p double")).collect()}
    for cls in range(4):
        own = [(y, p) for c, y, p in rows if c == cls]
        best, at = -1, None
        for i in range(49):
            t = 0.02 + i * 0.02
            called = sum(p >= t for _, p in own)
            f = round(2 * sum(y for y, p in own if p >= t) / max(called + sum(y for y, _ in own), 1), 9)
            if f > best:
                best, at = f, t
        assert got[cls] == pytest.approx(at)
    assert got[9] == 0.5


def test_a_detection_has_no_second_choice(spark):
    box = "uid string, k long, cls int, x1 double, y1 double, x2 double, y2 double"
    gt = spark.createDataFrame([("a", 1, 0, 0.0, 0.0, 10.0, 10.0), ("a", 2, 0, 0.0, 0.0, 10.0, 9.0), ("b", 1, 1, 0.0, 0.0, 5.0, 5.0)], box)
    det = spark.createDataFrame([("a", 1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), ("a", 2, 0, 0.0, 0.0, 10.0, 10.0, 0.8), ("c", 1, 0, 0.0, 0.0, 1.0, 1.0, 0.7)], box + ", score double")
    assert {(r.uid, r.k): r.tp for r in detection.matched(det, gt).collect()} == {("a", 1): 1, ("a", 2): 0, ("c", 1): 0}
    assert {r.cls: r.ap for r in detection.box_ap(det, gt).collect()} == {0: 0.5, 1: 0.0}


def test_boxes(spark):
    df = spark.createDataFrame([([0.1, 0.1, 0.5, 0.5], 100.0, 200.0), ([30.0, 40.0, 10.0, 20.0], 100.0, 100.0), ([5.0, 5.0, 5.5, 9.0], 10.0, 10.0)], "v array<double>, w double, h double")
    v = [F.col("v")[i] for i in range(4)]
    got = [r.b for r in df.select(G.resolve_box(v, "xyxy", F.col("w"), F.col("h")).alias("b")).collect()]
    assert tuple(got[0]) == (10.0, 20.0, 50.0, 100.0) and tuple(got[1]) == (10.0, 20.0, 30.0, 40.0) and got[2] is None
    assert spark.range(1).select(G.letterbox(F.lit(None).cast("double"), F.lit(5.0), 64).alias("b")).head().b is None


def test_labels(spark):
    raw = [None, "", "class 22", "22", "Class 3", "pliars", "utility knife blade", "3D printed gun", "Scissors!", "threat", "zzz", "7", "ieddevice", "3d part", "class 4_Knife", "class 9 threat", "class 400", " CLASS_5 - "]
    df = spark.createDataFrame([(x,) for x in raw], "raw string").select("raw", label_class(F.col("raw")).alias("m"))
    got = {r.raw: (r.m.cls, r.m.status) for r in df.collect()}
    assert got[None] == (-1, "missing") and got[""] == (-1, "generic") and got["class 22"] == (-1, "ignore") and got["22"] == (-1, "unmapped")
    assert got["Class 3"] == (2, "numeric") and got["pliars"][0] == 15 and got["utility knife blade"][0] == 4 and got["3D printed gun"][0] == 2
    assert got["ieddevice"] == (0, "fuzzy") and got["3d part"] == (2, "fuzzy") and got["class 4_Knife"] == (3, "ok") and got["class 9 threat"] == (-1, "generic")
    assert got["class 400"] == (-1, "unmapped") and got[" CLASS_5 - "] == (4, "numeric") and got["pliars"] == (15, "fuzzy")
    assert got["Scissors!"] == (13, "ok") and got["threat"][1] == "generic" and got["zzz"] == (-1, "unmapped") and got["7"] == (6, "numeric")
    r = spark.range(1).select(folder_class(F.lit("class-12_Other Sharp")).alias("a"), folder_class(F.lit("Images")).alias("b"), safe_name(F.lit("//")).alias("c"), duration(F.lit(3725.9)).alias("d"), duration(F.lit(184)).alias("e")).head()
    assert (r.a.id, r.a.label, r.b.id, r.c, r.d, r.e) == (12, "Other Sharp", None, "x", "1h02m", "3m04s")


def test_near_signatures_miss_nothing(spark):
    rng = random.Random(5)
    base = [(rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63) for _ in range(60)]

    def flipped(s, n):
        d, a = s[0] % 2**64, s[1] % 2**64
        for b in rng.sample(range(128), n):
            d, a = (d ^ (1 << b), a) if b < 64 else (d, a ^ (1 << (b - 64)))
        return (d - 2**64 if d >= 2**63 else d, a - 2**64 if a >= 2**63 else a)

    rows = base + [flipped(s, n) for s in base for n in (1, 11, 12, 13)]
    df = spark.createDataFrame([(f"u{i:04}", d, a) for i, (d, a) in enumerate(rows)], "uid string, sig_d long, sig_a long")
    sigs = splits.signatures(df)
    gap = lambda x, y: sum(((p ^ q) % 2**64).bit_count() for p, q in zip(x, y, strict=True))
    every = {(f"u{i:04}", f"u{j:04}", gap(rows[i], rows[j])) for i in range(len(rows)) for j in range(i + 1, len(rows))}
    for most in (12, 2, 1, 0):
        got = {(r.a, r.b, r.distance) for r in splits.near_duplicates(sigs, most).collect()}
        assert got == {p for p in every if 0 < p[2] <= most}
    groups, bits = splits.duplicate_groups(splits.signatures(df))
    assert groups.count() == len(rows) and bits == 12


def test_near_signatures_of_a_full_block(spark):
    rng = random.Random(7)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    # A third of all share their lower 40 bits, so all blocks there are full.
    rows = list({(rng.getrandbits(24) << 40 | 12345 if i % 3 == 0 else rng.getrandbits(64), rng.choice([7, 7 ^ 1 << rng.randint(0, 63), rng.getrandbits(64)])) for i in range(240)})
    df = spark.createDataFrame([(signed(d), signed(a)) for d, a in rows], "d long, a long")
    for most in (12, 20):
        want = Counter((signed(d), signed(a), signed(e), signed(b), n) for d, a in rows for e, b in rows if (n := (d ^ e).bit_count() + (a ^ b).bit_count()) <= most)
        for full in (4, 20, 10**6):
            assert Counter(tuple(r) for r in splits.near_signatures(df, df, most, full).collect()) == want


def test_groups_tighten_until_none_is_too_large(spark):
    chain = [(1 << i) - 1 for i in range(12)]  # neighbours one bit apart: one group at any limit from 1 on
    far = [random.Random(i).getrandbits(62) << 1 for i in range(30)]
    df = spark.createDataFrame([(f"u{i:02}", x, 5) for i, x in enumerate(chain + far)], "uid string, sig_d long, sig_a long")
    groups, bits = splits.duplicate_groups(splits.signatures(df))
    assert bits == 0 and groups.select("group").distinct().count() == 42
    wide = [sum(1 << (5 * j) for j in range(i)) for i in range(12)] + [sum(1 << (5 * j) for j in range(3)) | 0b111 << 61 - 1]
    df = spark.createDataFrame([(f"u{i:02}", x, 5 << (i // 6) * 6) for i, x in enumerate(wide)], "uid string, sig_d long, sig_a long")
    groups, bits = splits.duplicate_groups(splits.signatures(df))
    assert 0 <= bits < 12 and max(Counter(r.group for r in groups.collect()).values()) <= 10


def test_robust_fit_of_few_values(spark):
    fit = lambda v: tuple(anomaly.robust_fit(spark.createDataFrame([(x,) for x in v], "x double"), "x").head())
    assert fit([]) == (0.0, 1.0)
    assert fit([2.0, 2.0, float("nan")]) == (2.0, 1e-6)
    assert fit([1.0, 2.0, 3.0, 100.0, float("inf")]) == pytest.approx((2.5, 1.4826))


def test_registry(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "run string, map double")
    new = spark.createDataFrame([("b", 5.0, 1)], "run string, map double, extra int")
    assert sorted((r.run, r.map, r.extra) for r in experiments.upsert(old, new).collect()) == [("a", 1.0, None), ("b", 5.0, 1)]
    deps = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "b"), ("d", "c")], "name string, dep string")
    specs = spark.createDataFrame([("a", 1), ("b", 10), ("c", 100), ("d", 1000)], "name string, minutes int")
    assert {r.name: r.minutes for r in experiments.estimates(specs, deps).collect()} == {"a": 1, "b": 11, "c": 111, "d": 1111}


@pytest.mark.parametrize("name", ["bootstrap_map_ci_1000", "paired_delta_1000", "auroc_ci_1000", "result_row_1000"])
def test_whole_bootstrap_is_registered(spark, small, monkeypatch, name):
    from baglight.operators import bootstrap
    from baglight.plans import registry

    drawn = []
    kept = bootstrap.replicates
    monkeypatch.setattr(bootstrap, "replicates", lambda rows, n, seed: drawn.append(n) or kept(rows, n, seed))
    assert registry.QUERIES[name](spark, small).columns == registry.QUERIES[name.removesuffix("_1000")](spark, small).columns
    assert drawn == [1000, 50]


def test_classes_of_proposals_by_their_own_crops(spark):
    crops = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.2), (1, 1, 0, 0.1), (1, 1, 1, 0.8), (1, 1, 2, 0.01), (2, 0, 0, 0.4)], "uid int, k int, cls int, p double")
    scans = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.0), (1, 2, 0.0)], "uid int, cls int, p double")
    got = lambda df: {(r.uid, r.k, r.cls): round(r.score, 6) for r in df.collect()}
    assert got(detection.crop_boxes(crops, classes=1)) == {(1, 0, 0): 0.9, (1, 1, 1): 0.8, (2, 0, 0): 0.4}
    assert got(detection.crop_boxes(crops, scans, mix=0.5)) == {(1, 0, 0): 0.7, (1, 0, 1): 0.1, (1, 1, 0): 0.3, (1, 1, 1): 0.4, (2, 0, 0): 0.4}


def test_proposals_in_their_pictures(spark):
    props = spark.createDataFrame([(1, 0, 0.9, 0.0, 20.0, 30.0, 60.0), (1, 1, 0.5, 0.0, 0.0, 50.0, 20.5)], "uid int, k int, peak double, x1 double, y1 double, x2 double, y2 double")
    scans = spark.createDataFrame([(1, 0.5, 0, 20, 50, 60)], "uid int, scale double, pad_x int, pad_y int, img_w int, img_h int")
    assert [tuple(r) for r in detection.placed(props, scans).collect()] == [(1, 0, 0.9, 0.0, 0.0, 50.0, 60.0)]


def test_rates_of_an_open_set(spark):
    from baglight.operators import cascade

    rows = [(i, "benign", i / 100) for i in range(100)] + [(200, "unknown", 0.97), (201, "unknown", 0.5), (202, "known", 1.0), (203, None, 1.0)]
    got = {(r.population, r.score): (r.tpr_at_fpr_5, r.tpr_at_fpr_1) for r in cascade.open_set_rates(spark.createDataFrame(rows, "uid int, population string, s double")).collect()}
    assert got[("known", "s")] == (1.0, 1.0) and got[("unknown", "s")] == (0.5, 0.0)


def test_bootstrap_weights_are_those_of_the_hash(spark):
    from baglight.operators.bootstrap import poisson_weight, replicates, uniform

    # Texts of one block, of just one and of more, none, and replicates of one to four digits.
    uids = ["s1", "", None, "é" * 30, "y" * 47, "y" * 48, "y" * 49, "y" * 50, "z" * 200, "s1"]
    rows = spark.createDataFrame([(u,) for u in uids], "uid string")
    got = replicates(rows, 1003, 7).select("uid", F.posexplode("w").alias("b", "w"))
    assert got.filter(F.col("w") != poisson_weight(uniform(7, F.col("b"), F.col("uid")))).count() == 0
    assert got.count() == 1003 * len(uids)


def test_bootstrapped_auroc_keeps_rows_as_they_are(spark, monkeypatch):
    from baglight.operators import bootstrap
    from baglight.operators.recognition import auroc

    nan = float("nan")
    scores = [0.0] * 150 + [i % 7 / 7 for i in range(60)] + [i / 40 for i in range(40)] + [nan, nan, -0.0, float("inf"), None]
    rows = [(f"u{i}", (i * 7919) % 3 == 0, p) for i, p in enumerate(scores)] + [("no label", None, 0.5)]
    df = spark.createDataFrame(rows, "uid string, threat boolean, score double").withColumn("threat", F.col("threat").cast("int"))
    each = df.select("uid", F.col("threat").alias("y"), F.col("score").alias("p")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(19))))
    w = bootstrap.poisson_weight(bootstrap.uniform(0, F.col("b"), F.col("uid")))
    want = {r.b: r.auroc for r in auroc(each.withColumn("w", w).filter("w > 0"), ["b"], F.col("w")).collect()}
    drawn = []
    kept = bootstrap.replicates
    monkeypatch.setattr(bootstrap, "replicates", lambda rows, n, seed: drawn.append(kept(rows, n, seed)) or drawn[-1])
    assert {r.b: r.auroc for r in bootstrap.bootstrap_auroc(df, 20).collect()} == pytest.approx(want)
    # Rows with a label and a score, once each and not once a replicate.
    assert drawn[0].count() == len(scores) - 1
    one = df.filter("threat = 1")
    assert bootstrap.auroc_interval(one, 5).collect() == [(None, None)] and bootstrap.auroc_interval(one.limit(0), 5).collect() == [(None, None)]
