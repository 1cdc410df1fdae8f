import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from baglight.llm import category_sample, related_splits, split_overlap
from baglight.llm.queries import QUERIES
from baglight.llm.sql import ORACLES
from tests.compare import from_spark, from_sql


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    assert from_spark(QUERIES[name](spark, small)) == from_sql(ORACLES[name], small)


SCANS = "uid string, bag_tag string, dup_group int, labels array<int>, root string, node string"


def scans(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCANS)


def union_find(rows):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for uid, tag, dup, _ in rows:
        clean = "".join(c for c in (tag or "") if c.isalnum()).upper()
        nodes = [("u", uid)]
        if any(c in "123456789" for c in clean):
            nodes.append(("t", clean))
        if dup is not None and dup >= 0:
            nodes.append(("g", dup))
        for n in nodes[1:]:
            parent[root(n)] = root(nodes[0])
        root(nodes[0])
    return {r[0]: root(("u", r[0])) for r in rows}


def test_groups_equal_union_find(spark):
    rng = random.Random(1)
    rows = [(f"u{i}", rng.choice([None, " ", "N/A", "00", f"a-{rng.randint(1, 60)}", f"A {rng.randint(1, 60)}"]), rng.choice([None, -1, -1, rng.randint(0, 40)]), None) for i in range(400)]
    rows += [(f"c{i}", f"Z{i}" if i % 2 else f"Z{i - 1}", 1000 + (i + 1) // 2, None) for i in range(1, 300)]  # one long chain
    rows += [(f"h{i}", "HOT-1", -1, [i % 20]) for i in range(350)]  # a third of all rows
    root = union_find(rows)
    got = {r.uid: r.root for r in related_splits.related_groups(scans(spark, rows)).collect()}
    assert len(got) == len(rows)
    pairs = Counter(zip((root[u] for u in got), got.values(), strict=True))
    assert len(pairs) == len(set(root.values())) == len(set(got.values()))
    found = {r.uid: r.group_tag for r in related_splits.groups_with_tag(scans(spark, rows)).collect()}
    size = Counter(root.values())
    assert set(found) == {u for u in root if size[root[u]] > 1}


def test_the_forest_spans(spark):
    rng = random.Random(2)
    edges = {(f"t:{rng.randint(0, 50)}", f"g:{rng.randint(0, 50)}") for _ in range(150)}
    df = spark.createDataFrame([(a, b, f"e{i:04}") for i, (a, b) in enumerate(sorted(edges))], "source string, target string, uid string")
    f = related_splits.spanning_forest(df)
    nodes = {x for e in edges for x in e}
    assert f.edges.count() == len(nodes) - f.roots.select("root").distinct().count() and f.roots.count() == len(nodes)
    assert f.rounds <= 8


def test_split_keeps_groups_whole_and_near_the_shares(spark):
    rng = random.Random(3)
    rows = [(f"u{i}", f"T{rng.randint(1, 1500)}", -1, [rng.randint(0, 4)] if i % 3 else None) for i in range(4000)] + [(f"h{i}", "T9999", -1, []) for i in range(800)]
    targets = spark.createDataFrame([("train", 700, 10), ("val", 120, 10), ("test", 180, 10)], "part string, share_permille int, tolerance_permille int")
    got = related_splits.split_related(scans(spark, rows), targets).collect()
    parts = defaultdict(set)
    for r in got:
        parts[r.root].add(r.part)
    assert len(got) == len(rows) and all(len(p) == 1 for p in parts.values())
    n = Counter(r.part for r in got)
    for p, share in (("train", 700), ("val", 120), ("test", 180)):
        assert abs(n[p] * 1000 / len(rows) - share) <= 10
    assert related_splits.split_related(scans(spark, []), targets).count() == 0
    assert related_splits.groups_with_tag(scans(spark, [])).count() == 0


def drawable(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], "uid string, part string, cache_ok boolean, labels array<int>, p int, need string")


TARGET = "part string, class_id int, share_permille int, min_rows long, sample_rows long"


def test_sample_meets_sizes_floors_and_reports_what_is_missing(spark):
    rng = random.Random(4)
    rows = [(f"u{i}", "train", True, [rng.choice([0, 0, 0, 1, 2])] + ([3] if rng.random() < 0.05 else [])) for i in range(3000)]
    rows += [("e1", "train", True, []), ("e2", "train", True, [None, 99]), ("e3", "train", None, [0]), ("e4", "train", True, None), ("e5", None, True, [0]), ("e6", "train", True, [4, 4, 4])]
    targets = spark.createDataFrame([("train", 0, 300, 5, 600), ("train", 1, 400, 5, 600), ("train", 2, 200, 5, 600), ("train", 3, 90, 60, 600), ("train", 4, 10, 2, 600), ("train", -1, 0, 3, 600), ("val", 0, 1000, 1, 10)], TARGET)
    sample, report = category_sample.sample_to_targets(drawable(spark, rows), targets)
    got = sample.collect()
    assert len(got) == 600 == len({r.uid for r in got}) and not {r.uid for r in got} & {"e2", "e3", "e4", "e5"}
    r = {(x.part, x.class_id): x for x in report.collect()}
    assert r["train", 4].supply == 1 and r["train", 4].short == 5 and r["train", -1].short == 2 and r["val", 0].short == 10
    # Rows of class 3 carry another class as well, so 600 rows hold about 54 classes more than the targets ask for.
    assert r["train", 3].drawn >= 60 and 220 <= r["train", 1].drawn <= 270 and 160 <= r["train", 0].drawn <= 205
    again = category_sample.sample_to_targets(drawable(spark, rows), targets)[0]
    assert {x.uid for x in again.collect()} == {x.uid for x in got}


def test_sample_reaches_every_need_that_can_be_reached_or_says_so(spark):
    rng = random.Random(8)
    rows = [(f"u{i}", "val", True, sorted(rng.sample(range(6), rng.choice([1, 1, 2])))) for i in range(900)] + [(f"s{i}", "val", True, [7]) for i in range(45)]
    targets = spark.createDataFrame([*[("val", c, 150, 5, 400) for c in range(6)], ("val", 7, 100, 42, 400), ("val", 8, 0, 2, 400)], TARGET)
    sample, report = category_sample.sample_to_targets(drawable(spark, rows), targets)
    counted = Counter(c for r in sample.collect() for c in r.classes)
    assert sample.count() == 400
    for r in report.collect():
        assert r.drawn == counted[r.class_id] and r.short == max(0, r.need - r.drawn) and (r.short == 0 or r.class_id == 8)


def test_sample_of_nothing(spark):
    targets = spark.createDataFrame([("train", 0, 1000, 5, 10)], TARGET)
    sample, report = category_sample.sample_to_targets(drawable(spark, []), targets)
    assert sample.count() == 0 and report.head().short == 10


@pytest.mark.parametrize("path", ["STCray_A/Images/Class 1_X/a.jpg", "D:\\x\\STCRAY_A\\Images\\.\\Class%201_X\\A.JPG", "//n/stcray_a//Json/../Images///class 1_x/a.jpg", "./STCray_A/Images/Class 1_X/a.jp%67"])
def test_spellings_of_one_file(spark, path):
    assert spark.createDataFrame([(path,)], "p string").select(split_overlap.same_file_name(F.col("p")).alias("f")).head().f == "stcray_a/images/class 1_x/a.jpg"


def test_paths_that_name_no_file(spark):
    got = spark.createDataFrame([(None,), ("",), ("x/y.jpg",), ("stcray_a/100%.jpg",)], "p string").select(split_overlap.same_file_name(F.col("p")).alias("f")).collect()
    assert [r.f for r in got] == [None, None, None, "stcray_a/100%.jpg"]


def test_chunks_put_together_are_the_text_and_follow_the_content(spark):
    rng = random.Random(5)
    body = "".join(rng.choice("abcdefgh/_0123456789é") for _ in range(4000))
    rows = [(1, body), (2, "other head " + body), (3, ""), (4, None), (5, "abc"), (6, "x" * 500)]
    got = split_overlap.chunks(spark.createDataFrame(rows, "k int, t string"), "t").collect()
    size = Counter()
    digests = defaultdict(set)
    for r in got:
        size[r.k] += r.bytes
        digests[r.k].add((r.digest, r.bytes))
    assert size == {k: len((t or "").encode()) for k, t in rows if t}
    assert sum(n for _, n in digests[1] & digests[2]) > 0.9 * len(body.encode())


def test_overlap_fractions(spark):
    text = "same text as in the other split, word for word"
    df = spark.createDataFrame([("train", text), ("val", text), ("val", "nothing of this one is anywhere else 12345"), ("test", None), ("train", None)], "part string, file string")
    got = {r.file: r.fraction for r in split_overlap.file_overlaps(df).collect()}
    assert len(got) == 2 and got.pop(text) == 1.0 and max(got.values()) < 0.5


def test_pairs_by_brute_force(spark):
    rng = random.Random(6)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(40)]
    rows = []
    for i in range(400):
        d, a = rng.choice(base)
        for b in rng.sample(range(128), rng.choice([0, 0, 3, 6, 7, 9])):
            d, a = (d ^ (1 << b), a) if b < 64 else (d, a ^ (1 << (b - 64)))
        rows.append((f"u{i}", rng.choice(["train", "val", "test", None]), f"S/STCray_T/{rng.randint(0, 300)}.jpg", signed(d), signed(a)))
    rows += [("z1", "train", None, 0, 0), ("z2", "val", None, 0, 0), ("z3", "test", None, None, 5), ("z4", "train", "STCray_T\\5.JPG", None, 5)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "uid string, part string, img_path string, sig_d long, sig_a long, d string")
    got = {tuple(r) for r in split_overlap.ordered_pairs(split_overlap.cross_split_pairs(df)).collect()}
    name = lambda p: p and p.replace("\\", "/").lower().rsplit("stcray_", 1)[1]
    want = set()
    for u, p, f, d, a in rows:
        for v, q, g, e, b in rows:
            if p == "train" and q in ("val", "test"):
                near = None not in (d, a, e, b) and (d, a) != (0, 0) and (e, b) != (0, 0) and ((d ^ e) % 2**64).bit_count() + ((a ^ b) % 2**64).bit_count() <= 12
                if near or name(f) and name(f) == name(g):
                    want.add(tuple(sorted((u, v))))
    assert got == want
    assert split_overlap.cross_split_pairs(df.limit(0)).count() == 0
    report = split_overlap.overlap_report(df.withColumn("folder_name", F.lit("x")))
    assert sum(r.pairs for r in report.collect()) == len(want)
    assert sum(r.overlapping for r in report.collect()) == len({v for p in want for v in p if v in {r[0] for r in rows if r[1] in ("val", "test")}})
