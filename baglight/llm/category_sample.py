"""Sample matching target category proportions.

Every part gets a sample of a given size in which each class has its share of the rows, at least
a minimum, or all there is. A row may carry several classes, so inclusion probabilities are raked:
each class has one factor, a row's probability is the product of its classes' factors, and the
factors are adjusted until every class expects its target. Only the patterns of classes with their
counts, and the factors (one a part and class), take part in that.

Rows are then sorted by part, pattern and a random number, their probabilities are summed in that
order across partitions, and the rows at which the sum crosses an integer after one random start
are taken (systematic unequal-probability sampling). Classes below their need are then repaired
from the rows not taken, and as many rows are given back from classes above their target. Where the
needs of a part add up to more than its size, rows are given back down to min_rows; the report says
by how many rows a class stays short.

Need of a class: the larger of min_rows and share_permille * sample_rows / 1000 rounded up.
Supply: rows of the part with cache_ok true and labels not null that carry the class; class -1 is
an empty list of labels.

Defined cases: ids outside 0-19 and null ids are ignored, and repeated ids count once; a list with
nothing but such ids has no class and can fill a sample only where no class is wanted, that is
never; null parts match no target; a part without supply gives no rows and all its classes in the
report; an empty table gives an empty sample and the whole need as short.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baglight.functions.stage import stage
from baglight.operators.rows import running_sum

#: Classes are the ids below this, and rounds after which raking ends at the latest: defaults of sample_to_targets.
CLASSES = 20
RAKE_ROUNDS = 100


def classed(scans: DataFrame, classes: int = CLASSES) -> DataFrame:
    """uid, part, classes (sorted, distinct; [-1] for an empty list) of the rows that can be drawn."""
    ok = scans.filter(F.col("cache_ok") & F.col("labels").isNotNull() & F.col("part").isNotNull())
    kept = F.array_sort(F.array_distinct(F.filter("labels", lambda c: c.isNotNull() & c.between(0, classes - 1))))
    return ok.select("uid", "part", F.when(F.size("labels") == 0, F.array(F.lit(-1))).otherwise(kept).alias("classes"))


def needs(targets: DataFrame) -> DataFrame:
    """part, class_id, need, min_rows, sample_rows; repeated targets of a class count once, by their largest values."""
    share = F.ceil(F.col("share_permille") * F.col("sample_rows") / F.lit(1000.0)).cast("long")
    return targets.withColumn("need", F.greatest("min_rows", share)).groupBy("part", "class_id").agg(F.max("need").alias("need"), F.max("min_rows").alias("min_rows"), F.max("share_permille").alias("share_permille"), F.max("sample_rows").alias("sample_rows"))


def _rake(patterns: DataFrame, wanted: dict, rounds: int) -> dict:
    """Factor of each (part, class), so that the expected rows of each class come near wanted.

    A part has at most 2 ** classes + 1 patterns, and with 20 classes these are few whatever the rows, so one task holds them as bit masks and
    counts (12 MB at the very most) and adjusts the factors in place.
    """
    if not wanted:
        return {}

    def adjust(key: tuple, t: pa.Table) -> pa.Table:
        part = key[0].as_py()
        ids = sorted(c for p, c in wanted if p == part)
        n = np.asarray(t.column("n")).astype(np.float64)
        mask = np.asarray(t.column("mask"))
        has = [(mask >> (c + 1)) & 1 == 1 for c in ids]
        # A pattern with a class that isn't wanted is never drawn.
        mine = sum(1 << (c + 1) for c in ids)
        base = ((mask & ~np.int64(mine)) == 0) & (mask != 0)
        factor = np.ones(len(ids))
        for _ in range(rounds):
            p = np.where(base, n, 0.0)
            share = np.ones(len(n))
            for h, f in zip(has, factor, strict=True):
                share[h] *= f
            p *= np.minimum(share, 1.0)
            worst = 0.0
            for i, c in enumerate(ids):
                have, want = p[has[i]].sum(), wanted[part, c]
                if have > 0:
                    worst = max(worst, abs(have / want - 1))
                    factor[i] = min(1e6, max(1e-9, factor[i] * (want / have) ** 0.7))
            if worst < 0.01:
                break
        return pa.table({"part": pa.array([part] * len(ids), pa.string()), "class_id": pa.array(ids, pa.int32()), "factor": pa.array(factor, pa.float64())})

    bits = F.aggregate("classes", F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(F.pow(F.lit(2.0), c + 1).cast("long")))
    bits = F.when(F.array_contains("classes", -1), F.lit(1).cast("long")).otherwise(bits)
    got = patterns.select("part", bits.alias("mask"), "n").groupBy("part").applyInArrow(adjust, "part string, class_id int, factor double")
    return {(r.part, r.class_id): r.factor for r in got.collect()}  # a row a part and class


def with_probability(rows: DataFrame, factor: dict) -> DataFrame:
    """Adds p: the product of the classes' factors, at most 1."""
    if not factor:
        return rows.withColumn("p", F.lit(0.0))
    table = F.create_map(*[x for (part, c), f in sorted(factor.items()) for x in (F.lit(f"{part}\x00{c}"), F.lit(f))])
    of = F.transform("classes", lambda c: F.coalesce(F.element_at(table, F.concat_ws("\x00", "part", c.cast("string"))), F.lit(0.0)))
    p = F.least(F.lit(1.0), F.aggregate(of, F.lit(1.0), lambda a, x: a * x))
    return rows.withColumn("p", F.when(F.size("classes") == 0, F.lit(0.0)).otherwise(p))


def sample_to_targets(scans: DataFrame, targets: DataFrame, seed: int = 11, classes: int = CLASSES, rounds: int = RAKE_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The sample (uid, part, classes) and the report (part, class_id, need, supply, drawn, short) with a row a target.

    short: the rows by which the drawn sample stays below the need, whether the supply is too small
    or the part's needs together are more than its size.
    """
    need = needs(targets)
    rows = stage(classed(scans, classes).join(F.broadcast(need.select("part").distinct()), "part", "left_semi"), "classed")
    patterns = stage(rows.groupBy("part", "classes").agg(F.count("*").alias("n")), "patterns")
    supply = patterns.select("part", F.explode("classes").alias("class_id"), "n").groupBy("part", "class_id").agg(F.sum("n").alias("supply"))
    spec = need.join(supply, ["part", "class_id"], "left").fillna(0, ["supply"]).collect()  # a row a part and class
    aim, floor, reach, size = {}, {}, {}, {}
    for r in spec:
        # A class that can't meet its need keeps all it has.
        floor[r.part, r.class_id] = min(r.min_rows if r.supply >= r.need else r.supply, r.supply)
        reach[r.part, r.class_id] = min(r.need, r.supply)
        aim[r.part, r.class_id] = min(max(floor[r.part, r.class_id], r.share_permille * r.sample_rows / 1000), r.supply)
        size[r.part] = r.sample_rows
    p = with_probability(rows, _rake(patterns, {k: v for k, v in aim.items() if v > 0}, rounds))
    total = {r.part: r.p for r in p.groupBy("part").agg(F.sum("p").alias("p")).collect()}  # a row a part
    scale = F.coalesce(*[F.when(F.col("part") == k, F.lit(min(1.0, size[k] / v) if v else 0.0)) for k, v in total.items()], F.lit(0.0)) if total else F.lit(0.0)
    p = p.withColumn("p", F.col("p") * scale).withColumn("draw", F.xxhash64(F.lit(seed), "uid"))
    summed = running_sum(p, [F.col("part"), F.col("classes"), F.col("draw"), F.col("uid")], F.col("p"), "upto")
    start = ((seed * 2654435761) % 1000003) / 1000003
    taken = F.floor(F.col("upto") + start) > F.floor(F.col("upto") - F.col("p") + start)
    drawn = stage(summed.withColumn("taken", taken), "drawn")

    def counts(df: DataFrame) -> dict:
        return {(r.part, r.class_id): r.n for r in df.select("part", F.explode("classes").alias("class_id")).groupBy("part", "class_id").agg(F.count("*").alias("n")).collect()}  # a row a part and class

    have = counts(drawn.filter("taken"))
    short = {k: f - have.get(k, 0) for k, f in reach.items() if f > have.get(k, 0)}
    got = {r.part: r["count"] for r in drawn.filter("taken").groupBy("part").count().collect()}  # a row a part
    fixed = drawn.select("uid", "part", "classes", "taken", "draw")
    if short:
        # Repair: the first rows by draw of each class below what it can reach of its need. The rank is filtered below the shuffle.
        lack = _lookup(short, F.col("part"), F.col("class_id"))
        spare = drawn.filter("not taken").select("uid", "part", "draw", F.explode("classes").alias("class_id")).withColumn("lack", lack).filter("lack > 0")
        first = spare.withColumn("n", F.row_number().over(Window.partitionBy("part", "class_id").orderBy("draw", "uid"))).filter(F.col("n") <= F.lit(max(short.values()))).filter("n <= lack")
        added = stage(first.select("uid").distinct().withColumn("added", F.lit(True)), "added")
        fixed = stage(fixed.join(added, "uid", "left").withColumn("taken", F.col("taken") | F.coalesce("added", F.lit(False))), "repaired")
        have = counts(fixed.filter("taken"))
        got = {r.part: r["count"] for r in fixed.filter("taken").groupBy("part").count().collect()}
    sample = _resize(fixed, aim, floor, have, size, got)
    final = stage(sample.select("uid", "part", "classes"), "sample")
    drawn_of = final.select("part", F.explode("classes").alias("class_id")).groupBy("part", "class_id").agg(F.count("*").alias("drawn"))
    report = need.join(supply, ["part", "class_id"], "left").join(drawn_of, ["part", "class_id"], "left").fillna(0, ["supply", "drawn"])
    report = report.select("part", "class_id", "need", "supply", "drawn", F.greatest(F.col("need") - F.col("drawn"), F.lit(0)).alias("short"))
    return final, report


def _lookup(values: dict, part, class_id):
    table = F.create_map(*[x for (p, c), v in sorted(values.items()) for x in (F.lit(f"{p}\x00{c}"), F.lit(int(v)))])
    return F.coalesce(F.element_at(table, F.concat_ws("\x00", part, class_id.cast("string"))), F.lit(0))


def _resize(rows: DataFrame, aim: dict, floor: dict, have: dict, size: dict, got: dict) -> DataFrame:
    """Brings each part to its size: gives back rows of a single class that is above its aim, or adds rows of classes with supply left.

    How many of which class follows from counts (a row a part and class); which rows, from their rank by draw.
    """
    give, take = {}, {}
    single = F.when(F.size("classes") == 1, F.element_at("classes", 1))
    alone = {(r.part, r.single, r.taken): r["count"] for r in rows.withColumn("single", single).filter("single is not null").groupBy("part", "single", "taken").count().collect()}  # two rows a part and class
    for part, want in size.items():
        over = got.get(part, 0) - want
        mine = {c: have.get((part, c), 0) for (p, c) in aim if p == part}
        if over > 0:
            for least in (ceil, lambda x: 0):
                room = {c: min(alone.get((part, c, True), 0), max(0, n - max(floor[part, c], least(aim[part, c])))) - give.get((part, c), 0) for c, n in mine.items()}
                for c, n in _shares(over, room, room).items():
                    give[part, c] = give.get((part, c), 0) + n
                    over -= n
        elif over < 0:
            room = {c: alone.get((part, c, False), 0) for c in mine}
            for c, n in _shares(-over, room, {c: max(aim[part, c], 1e-3) for c in mine}).items():
                take[part, c] = n
    out = rows.withColumn("single", single)
    if give:
        rank = F.row_number().over(Window.partitionBy("part", "single").orderBy(F.col("draw").desc(), F.col("uid").desc()))
        back = out.filter("taken and single is not null").withColumn("quota", _lookup(give, F.col("part"), F.col("single"))).filter("quota > 0").withColumn("n", rank).filter(F.col("n") <= F.lit(max(give.values()))).filter("n <= quota")
        out = out.join(back.select("uid", F.lit(True).alias("back")), "uid", "left").withColumn("taken", F.col("taken") & F.col("back").isNull())
    if take:
        rank = F.row_number().over(Window.partitionBy("part", "single").orderBy("draw", "uid"))
        more = out.filter("not taken and single is not null").withColumn("quota", _lookup(take, F.col("part"), F.col("single"))).filter("quota > 0").withColumn("n", rank).filter(F.col("n") <= F.lit(max(take.values()))).filter("n <= quota")
        out = out.join(more.select("uid", F.lit(True).alias("more")), "uid", "left").withColumn("taken", F.col("taken") | F.col("more").isNotNull())
    return out.filter("taken")


def _shares(amount: int, room: dict, weight: dict) -> dict:
    """Whole numbers adding up to amount, or to all the room there is, in proportion to weight and never above room."""
    out = {k: 0 for k in room}
    while amount > 0 and (open_ := {k: weight[k] for k in room if room[k] > out[k] and weight[k] > 0}):
        whole, left = sum(open_.values()), amount
        for k in sorted(open_, key=lambda k: (-open_[k], k)):
            n = min(room[k] - out[k], left, ceil(amount * open_[k] / whole))
            out[k] += n
            left -= n
        amount = left
    return out
