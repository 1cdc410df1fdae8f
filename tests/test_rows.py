import random

from pyspark.sql import functions as F

from baglight.operators.graph import components
from baglight.operators.rows import latest, running_sum


def test_latest_takes_one_row_a_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("a", 2, "z"), ("b", None, "n"), (None, 5, "q")], "k string, at int, v string")
    assert sorted((r.k, r.v) for r in latest(df, "k", "at").collect()) == [("a", "z"), ("b", "n")]
    assert latest(df.limit(0), "k", "at").count() == 0


def test_running_sum_is_exact_over_partitions(spark):
    rng = random.Random(1)
    data = [(i, rng.randint(0, 3), rng.randint(1, 9)) for i in range(500)]
    got = running_sum(spark.createDataFrame(data, "id int, g int, v int"), [F.col("g"), F.col("id")], F.col("v"), "upto", 7).orderBy("g", "id").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.upto == total
    assert len(got) == 500
    assert running_sum(spark.createDataFrame([], "id int, v int"), [F.col("id")], F.col("v"), "upto").count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 199), rng.randint(0, 199)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_sums_from_the_top_of_any_scores(spark):
    import random

    from pyspark.sql import functions as F

    from baglight.operators.rows import greatest_below, sums_from_top

    rng = random.Random(3)
    scores = [0.0, -0.0, 1.0, 0.25, 0.250001, -3.5, 1e300, -1e300, 1e-300, 5e5, 5e5 + 1, float("inf"), float("-inf")] + [rng.random() for _ in range(300)] + [rng.gauss(0, 1e6) for _ in range(60)]
    rows = [(g, i, s, rng.randint(0, 5)) for g in ("a", "b") for i, s in enumerate(scores) if g == "a" or i % 3]
    df = spark.createDataFrame(rows, "g string, i int, s double, v int")
    then = (F.col("i"),)
    got = {(r.g, r.i): (r.n, r.t, r.m) for r in greatest_below(sums_from_top(df, ["g"], "s", {"n": F.lit(1), "t": F.col("v")}, then), ["g"], "s", "v", "m", then).collect()}
    assert len(got) == len(rows)
    for g in ("a", "b"):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        for k, r in enumerate(order):
            assert got[g, r[1]] == (k + 1, sum(x[3] for x in order[: k + 1]), max(x[3] for x in order[k:]))
    assert sums_from_top(df.limit(0), ["g"], "s", {"n": F.lit(1)}).count() == 0
