"""Splits that keep related records together.

Scans tied by a bag tag or by a group of duplicates, also through other scans, must share a part.
Tags and groups are the nodes of a graph and every scan that has both is an edge, so a tag on a
third of all rows is one node, never a set of pairs. A spanning forest is grown by Borůvka's
rounds: each tree picks its least outgoing edge, the picked edges are contracted, and both the
forest's edges and the contracted graph are written before the next round. Rounds are logarithmic
in the number of nodes.

Trees are then dealt to the parts: the few that hold more than 1/2000 of all scans (at most 2000,
whatever the input) go one by one to the part with the greatest open need; all others are ordered
by size band and rarest label and dealt systematically, by a low-discrepancy sequence over their
rank, in proportion to what each part still lacks.

Defined cases: null, blank and placeholder tags (none of the digits 1-9) tie nothing; a null or
negative group ties nothing; rows without uid are left out; null labels count as no label; an
empty table gives empty results. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baglight.functions.stage import drop_stage, stage
from baglight.operators.rows import running_sum

GOLDEN = 0.6180339887498949
LARGE = 2000


def clean_tag(tag: Column) -> Column:
    """Letters and digits of a tag in upper case; null where no digit 1-9 is left."""
    kept = F.upper(F.regexp_replace(tag, r"[^\p{L}\p{N}]", ""))
    return F.when(kept.rlike("[1-9]"), kept)


def tied(scans: DataFrame) -> DataFrame:
    """uid with its nodes: tag_node, group_node (either may be null)."""
    return scans.select(
        "uid",
        F.concat(F.lit("t:"), clean_tag(F.col("bag_tag"))).alias("tag_node"),
        F.when(F.col("dup_group") >= 0, F.concat(F.lit("g:"), F.col("dup_group").cast("string"))).alias("group_node"),
    )


@dataclass
class Forest:
    """edges: the spanning forest (source, target, uid, round); roots: node, root for every node with an edge."""

    edges: DataFrame
    roots: DataFrame
    rounds: int


def _roots_of(parents: DataFrame) -> DataFrame:
    """Pointer doubling until every node points at its root; parents: node, parent with roots pointing at themselves."""
    at = parents
    while True:
        up = at.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        new = stage(at.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "jump")
        done = not new.filter("moved").head(1)
        drop_stage(at)
        at = new.drop("moved")
        at._stage_path = new._stage_path
        if done:
            return at


def spanning_forest(edges: DataFrame) -> Forest:
    """Borůvka-style contraction of edges (source, target string; uid string, unique to an edge and its order)."""
    spark = edges.sparkSession
    graph = stage(edges.filter("source != target").select("source", "target", "uid", F.col("source").alias("s0"), F.col("target").alias("t0")), "graph")
    roots, picked, rounds = None, [], 0
    while graph.head(1):
        half = graph.select(F.col("source").alias("node"), F.struct("uid", F.col("target").alias("to"), "s0", "t0").alias("e")).union(
            graph.select(F.col("target").alias("node"), F.struct("uid", F.col("source").alias("to"), "s0", "t0").alias("e"))
        )
        least = stage(half.groupBy("node").agg(F.min("e").alias("e")).select("node", "e.*"), "least")
        picked.append(stage(least.select(F.col("s0").alias("source"), F.col("t0").alias("target"), "uid").distinct().withColumn("round", F.lit(rounds)), "forest"))
        # Unique weights leave no cycle but two nodes that picked the same edge; the smaller of them becomes the root.
        back = least.select(F.col("node").alias("to"), F.col("to").alias("back_to"))
        parents = least.join(back, "to", "left").select("node", F.when((F.col("back_to") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("parent"))
        up = _roots_of(stage(parents, "parents"))
        a, b = up.toDF("source", "sa"), up.toDF("target", "sb")
        small = graph.join(a, "source").join(b, "target").filter("sa != sb").select(F.col("sa").alias("source"), F.col("sb").alias("target"), "uid", "s0", "t0")
        # Of parallel edges only the least can ever be picked.
        small = small.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.min(F.struct("uid", "s0", "t0")).alias("e")).select("source", "target", "e.*")
        new = stage(small, "graph")
        if roots is None:
            merged = up.select("node", F.col("parent").alias("root"))
            merged._stage_path = up._stage_path
        else:
            merged = stage(roots.join(up.toDF("root", "new"), "root", "left").select("node", F.coalesce("new", "root").alias("root")), "roots")
            drop_stage(roots)
            drop_stage(up)
        drop_stage(graph)
        drop_stage(least)
        roots, graph, rounds = merged, new, rounds + 1
    if roots is None:
        return Forest(spark.createDataFrame([], "source string, target string, uid string, round int"), spark.createDataFrame([], "node string, root string"), 0)
    forest = picked[0]
    for x in picked[1:]:
        forest = forest.union(x)
    return Forest(forest, roots, rounds)


def related_groups(scans: DataFrame) -> DataFrame:
    """uid, root of every scan; a scan without any tie is its own root (`u:` and its uid)."""
    nodes = stage(tied(scans), "tied")
    edges = nodes.filter("tag_node is not null and group_node is not null").groupBy(F.col("tag_node").alias("source"), F.col("group_node").alias("target")).agg(F.min("uid").alias("uid"))
    roots = spanning_forest(edges).roots
    node = F.coalesce("tag_node", "group_node")
    return nodes.withColumn("node", F.coalesce(node, F.concat(F.lit("u:"), "uid"))).join(roots, "node", "left").select("uid", F.coalesce("root", "node").alias("root"), F.substring("tag_node", 3, 1 << 30).alias("tag"))


def groups_with_tag(scans: DataFrame) -> DataFrame:
    """uid, group_tag of every scan tied to another; group_tag: the least cleaned tag of its group."""
    member = stage(related_groups(scans), "member")
    groups = member.groupBy("root").agg(F.count("*").alias("n"), F.min("tag").alias("group_tag")).filter("n > 1")
    return member.select("uid", "root").join(groups, "root").select("uid", "group_tag")


def split_related(scans: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """uid, root, part for every scan of scans (uid, bag_tag, dup_group, labels), near the shares of targets (part, share_permille)."""
    spark = scans.sparkSession
    shares = {r.part: r.share_permille for r in targets.groupBy("part").agg(F.max("share_permille").alias("share_permille")).collect()}  # a row a part
    member = stage(related_groups(scans), "member")
    total = member.count()
    parts = sorted(shares, key=lambda p: (-shares[p], p))
    whole = sum(shares.values())
    if not total or not whole:
        return member.select("uid", "root", F.lit(None).cast("string").alias("part"))
    label = F.coalesce("label", F.lit(-1)).alias("label")
    labels = scans.select("uid", F.explode_outer(F.array_distinct("labels")).alias("label")).select("uid", label)
    counts = labels.groupBy("label").agg(F.count("*").alias("rows"))
    of_root = member.join(labels, "uid").select("root", "label").distinct()
    rarest = of_root.join(counts, "label").groupBy("root").agg(F.min_by("label", F.struct("rows", "label")).alias("label"))
    sizes = member.groupBy("root").agg(F.count("*").alias("n"))
    trees = stage(sizes.join(rarest, "root"), "trees")
    need = {p: total * shares[p] / whole for p in parts}
    large = trees.filter(F.col("n") * LARGE > total)  # fewer than LARGE rows, as their sizes add up to at most total
    dealt = []
    for r in sorted(large.collect(), key=lambda r: (-r.n, r.root)):
        p = max(parts, key=lambda p: (need[p], p))
        need[p] -= r.n
        dealt.append((r.root, p))
    rest = trees.filter(F.col("n") * LARGE <= total).withColumn("order", F.xxhash64(F.lit(seed), "root"))
    ranked = running_sum(rest, [-F.floor(F.log2("n")), F.col("label"), F.col("order"), F.col("root")], F.lit(1), "rank")
    left = {p: max(0.0, need[p]) for p in parts}
    open_ = sum(left.values()) or 1.0
    turn = F.pmod(F.col("rank") * F.lit(GOLDEN) + F.lit((seed % 97) / 97), F.lit(1.0))
    part, edge = F.lit(parts[-1]), 1.0
    for p in reversed(parts):
        part = F.when(turn < edge, F.lit(p)).otherwise(part)
        edge -= left[p] / open_
    small = ranked.select("root", part.alias("part"))
    placed = spark.createDataFrame(dealt, "root string, part string") if dealt else spark.createDataFrame([], "root string, part string")
    return member.select("uid", "root").join(small.union(placed), "root").select("uid", "root", "part")
