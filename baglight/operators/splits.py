"""Near-duplicates by 128-bit signatures, leakage between parts, split reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baglight.functions.stage import drop_stage, stage, width
from baglight.operators.graph import components
from baglight.operators.patches import hashed
from baglight.operators.rows import running_sum

#: Signatures filed under one block value, above which the value is divided.
FULL = 4096


def hamming(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Different bits of two signatures of two 64-bit halves."""
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def blocks(d: Column, a: Column, most: int, bits: int = 128) -> list[tuple[Column, int]]:
    """The lower `bits` bits in most // 2 + 1 blocks (two at least), value and width: two signatures at most `most` bits apart have a block with at most one bit different."""
    n = max(2, most // 2 + 1)
    at = [round(i * bits / n) for i in range(n + 1)]
    out = []
    for lo, hi in zip(at, at[1:], strict=False):
        parts = []
        for half, base in ((d, 0), (a, 64)):
            s, e = max(lo, base), min(hi, base + 64)
            if s < e:
                run = half if e - s == 64 else F.shiftrightunsigned(half, s - base).bitwiseAND(F.lit((1 << (e - s)) - 1))
                parts.append(F.shiftleft(run, s - lo) if s > lo else run)
        out.append((parts[0] if len(parts) == 1 else parts[0].bitwiseOR(parts[1]), hi - lo))
    return out


def _turned(d: Column, a: Column, by: int) -> tuple[Column, Column]:
    """The signature turned right by so many bits."""
    lo, hi = (d, a) if by % 128 < 64 else (a, d)
    r = by % 64
    if not r:
        return lo, hi
    join = lambda x, y: F.shiftrightunsigned(x, r).bitwiseOR(F.shiftleft(y, 64 - r))
    return join(lo, hi), join(hi, lo)


def _key(i: int, value: Column, bits: int) -> Column:
    """One number for block i with this value, i in the top byte; wide blocks are hashed, which can only add candidates."""
    value = value if bits <= 56 else F.xxhash64(value).bitwiseAND(F.lit((1 << 56) - 1))
    return value.bitwiseOR(F.lit(i << 56))


def _filed(made: list[tuple[Column, int]]) -> Column:
    """The key of every block."""
    return F.explode(F.array(*[_key(i, v, n) for i, (v, n) in enumerate(made)]))


def _probed(df: DataFrame, made: list[tuple[Column, int]], name: str) -> DataFrame:
    """df with the key of every block as it is and with each one bit flipped, as rows."""
    masks = [[0, *[(1 << j) - ((1 << 64) if j == 63 else 0) for j in range(n)]] for _, n in made]
    place, ends = F.col("__at"), [sum(map(len, masks[: i + 1])) for i in range(len(masks))]
    key = F.coalesce(*[F.when(place < e, _key(i, v.bitwiseXOR(F.col("__mask")), n)) for i, ((v, n), e) in enumerate(zip(made, ends, strict=True))])
    each = df.select("*", F.posexplode(F.lit(sum(masks, [])).cast("array<bigint>")).alias("__at", "__mask"))
    return each.withColumn(name, key).drop("__at", "__mask")


def _first(x: list[tuple[Column, int]]) -> Column:
    """Number of the first block of a difference with at most one bit set."""
    return F.coalesce(*[F.when(F.bit_count(v) <= 1, F.lit(i)) for i, (v, _) in enumerate(x)])


def near_signatures(left: DataFrame, right: DataFrame, most: int, full: int = FULL) -> DataFrame:
    """d, a, d2, a2, distance of the signatures (d, a) of both sides at most `most` bits apart; each side's signatures are distinct and not null.

    The left side looks up its blocks and every block with one bit flipped, the right side files its
    blocks: an equi-join on block values that misses no pair, checked by the exact distance. A pair
    counts where its first such block meets only, so nothing is found twice. Blocks filed more than
    `full` times (a margin that most pictures share) are divided once more, by the same rule over the
    bits outside the block, so that no key gathers a share of all rows. Both sides are many times
    the rows that the optimizer sees before the explode, hence the hint: neither may be broadcast.
    """
    left, right = left.select("d", "a"), right.select(F.col("d").alias("d2"), F.col("a").alias("a2"))
    made, theirs = blocks(F.col("d"), F.col("a"), most), blocks(F.col("d2"), F.col("a2"), most)
    # A few signatures become very many keys: they are spread over all tasks first, round robin, as the planner drops a repartition by their own columns.
    n = width(left.sparkSession)
    probes, filed = _probed(left.repartition(n), made, "key"), right.repartition(n).select("d2", "a2", _filed(theirs).alias("key"))
    hot = stage(filed.groupBy("key").count().filter(F.col("count") > full).select("key"), "hot")
    distance = hamming((F.col("d"), F.col("a")), (F.col("d2"), F.col("a2")))
    apart = [F.col("d").bitwiseXOR(F.col("d2")), F.col("a").bitwiseXOR(F.col("a2"))]
    number = F.shiftrightunsigned(F.col("key"), 56)
    mine = number == _first(blocks(*apart, most))
    out = lambda j: j.filter((distance <= most) & mine).select("d", "a", "d2", "a2", distance.alias("distance"))
    if not hot.head(1):
        drop_stage(hot)
        return out(probes.hint("merge").join(filed, "key"))
    cold = out(probes.join(hot, "key", "left_anti").hint("merge").join(filed.join(hot, "key", "left_anti"), "key"))
    ends = [round((i + 1) * 128 / len(made)) for i in range(len(made))]
    rest = 128 - min(bits for _, bits in made)

    def outside(d: Column, a: Column) -> list[tuple[Column, int]]:
        turned = [_turned(d, a, e) for e in ends]
        pick = lambda h: F.coalesce(*[F.when(number == i, t[h]) for i, t in enumerate(turned)])
        return blocks(pick(0), pick(1), most, rest)

    probes = _probed(probes.join(hot, "key", "left_semi").repartition(n), outside(F.col("d"), F.col("a")), "sub")
    filed = filed.join(hot, "key", "left_semi").repartition(n).withColumn("sub", _filed(outside(F.col("d2"), F.col("a2"))))
    divided = probes.hint("merge").join(filed, ["key", "sub"]).filter(F.shiftrightunsigned(F.col("sub"), 56) == _first(outside(*apart)))
    return cold.union(out(divided))


def signatures(scans: DataFrame, *more: str) -> DataFrame:
    """uid, d, a and further columns of scans with a signature; null and all-zero ones are none."""
    ok = "sig_d is not null and sig_a is not null and not (sig_d = 0 and sig_a = 0)"
    return scans.filter(ok).select("uid", F.col("sig_d").alias("d"), F.col("sig_a").alias("a"), *more)


def classes(sigs: DataFrame) -> DataFrame:
    """rep, d, a, scans: equal signatures as one class, named by its least uid."""
    return sigs.groupBy("d", "a").agg(F.min("uid").alias("rep"), F.count("*").alias("scans"))


def near_duplicates(sigs: DataFrame, most: int) -> DataFrame:
    """a < b, distance: pairs of classes of equal signatures, by their names."""
    c = stage(classes(sigs), "classes")
    near = near_signatures(c.select("d", "a"), c.select("d", "a"), most).filter("distance > 0")
    named = near.join(c.select("d", "a", F.col("rep").alias("x")), ["d", "a"]).join(c.select(F.col("d").alias("d2"), F.col("a").alias("a2"), F.col("rep").alias("y")), ["d2", "a2"])
    return named.filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), "distance")


def duplicate_groups(sigs: DataFrame, most: int = 12, least: int = 0, share: float = 0.02) -> tuple[DataFrame, int]:
    """(uid, group), bits: components of near-duplicates at the greatest limit from `most` down to `least` bits at which no group holds more than max(10, share of all), or at `least`.

    Pairs are found once, at the widest limit. Groups only shrink with the limit, so it is found by
    bisection. group is the least uid; scans alone have their own.
    """
    c = stage(classes(sigs), "classes")
    pairs = stage(near_duplicates(sigs, most), "pairs")
    total = sigs.count()

    def at(bits: int) -> tuple[DataFrame, bool]:
        comp = stage(components(pairs.filter(F.col("distance") <= bits).select("a", "b")).toDF("rep", "group"), "groups")
        named = c.join(comp, "rep", "left").withColumn("group", F.coalesce("group", "rep"))
        largest = named.groupBy("group").agg(F.sum("scans").alias("n")).agg(F.max("n")).head()[0] or 0
        return named, largest <= max(10, share * total)

    bits, (named, fits) = most, at(most)
    if not fits:
        bits, above = least, most
        named = None
        while above - bits > 1:
            middle = (bits + above) // 2
            tried, fits = at(middle)
            if fits:
                bits, named = middle, tried
            else:
                above = middle
        named = named or at(bits)[0]
    return sigs.join(named.select("d", "a", "group"), ["d", "a"]).select("uid", "group"), bits


def leakage(held_out: DataFrame, train: DataFrame, most: int = 12) -> DataFrame:
    """uid, distance of held-out signatures with a train signature at most `most` bits away: the least distance."""
    near = near_signatures(held_out.select("d", "a").distinct(), train.select("d", "a").distinct(), most).groupBy("d", "a").agg(F.min("distance").alias("distance"))
    return held_out.join(near, ["d", "a"]).select("uid", "distance")


def split_report(scans: DataFrame) -> DataFrame:
    """part, scans, threat, clean, multi of scans (part, labels); null labels count as none, ids as they stand."""
    n = F.coalesce(F.size(F.array_distinct("labels")), F.lit(0))
    flag = lambda c: F.sum(c.cast("int"))
    return scans.groupBy("part").agg(F.count("*").alias("scans"), flag(n > 0).alias("threat"), flag(n == 0).alias("clean"), flag(n > 1).alias("multi"))


def class_report(scans: DataFrame, ids: int) -> DataFrame:
    """cls, part, positives for every class below ids, 0 where there are none."""
    got = scans.select("part", "uid", F.explode(F.array_distinct("labels")).alias("cls")).groupBy("part", "cls").agg(F.count("*").alias("positives"))
    every = scans.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ids - 1))).alias("cls"))
    return every.join(got, ["part", "cls"], "left").fillna(0, ["positives"])


def select_part(scans: DataFrame, part: str, excluded: list[int]) -> DataFrame:
    """Cached scans of a part without any excluded label; null labels have none."""
    held = F.array(*[F.lit(i) for i in excluded]).cast("array<int>")
    clear = ~F.coalesce(F.arrays_overlap(F.array_compact("labels"), held), F.lit(False))
    return scans.filter((F.col("part") == part) & F.coalesce("cache_ok", F.lit(False)) & clear)


def subset(scans: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A share of scans (uid, labels) that keeps the share of every pattern of labels: within the patterns in hash order, each row at which the running share passes a whole number. Null labels are none, and null ids are passed over."""
    pattern = F.concat_ws(",", F.transform(F.array_sort(F.array_distinct("labels")), lambda c: c.cast("string")))
    order = [F.col("__pattern"), hashed(seed, "uid"), F.col("uid")]
    summed = running_sum(scans.withColumn("__pattern", pattern), order, F.lit(1).cast("long"), "__upto")
    at = lambda c: F.floor(c * F.lit(float(fraction)))
    return summed.filter(at(F.col("__upto")) > at(F.col("__upto") - 1)).drop("__pattern", "__upto")


def grouped_split(scans: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """uid, side ('val' or 'train') of scans (uid, group, labels): groups stay whole, and sizes and rarest labels are spread over both sides.

    Groups are ordered by size band, rarest label and hash, and every 1 / fraction-th goes to 'val'; a
    group larger than all of 'val' should be goes to 'train'.
    """
    long = scans.select("group", F.explode_outer(F.array_distinct("labels")).alias("label")).select("group", F.coalesce("label", F.lit(-1)).alias("label"))
    rows = long.groupBy("label").agg(F.count("*").alias("rows"))
    rare = long.distinct().join(rows, "label").groupBy("group").agg(F.min_by("label", F.struct("rows", "label")).alias("label"))
    groups = scans.groupBy("group").agg(F.count("*").alias("n")).join(rare, "group")
    order = [-F.floor(F.log2("n")), F.col("label"), hashed(seed, "group"), F.col("group")]
    total = scans.count()
    summed = running_sum(groups, order, F.lit(1).cast("long"), "upto")
    at = lambda c: F.floor(c * F.lit(float(fraction)) + 0.5)
    taken = (at(F.col("upto")) > at(F.col("upto") - 1)) & (F.col("n") <= total * fraction)
    return scans.join(summed.select("group", F.when(taken, "val").otherwise("train").alias("side")), "group").select("uid", "side")
