"""Paired bootstrap over scans.

Each replicate gives each scan a Poisson(1) weight drawn by inverse distribution from a portable
hash of (seed, replicate, uid), so both engines and all models see the same draw, no table of
weights is needed and a lost task draws the same again. A row has its weights of all replicates
side by side. The hashes of many rows and replicates are worked out at once, as arrays. For average
precision, weights are summed by (replicate, group, score) before any window; for AUROC, rows are
sorted by score in ranges and summed in that order for all replicates at once, so that rows are
never multiplied by replicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, StructType

from baglight.functions.stage import width
from baglight.operators.recognition import average_precision

#: The distribution of Poisson(1) up to 5.
POISSON = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)
#: Fixed values of MD5: additive constants, rotations, and the state it begins with.
_ADD = [np.uint32(int(abs(np.sin(i + 1.0)) * 2**32)) for i in range(64)]
_TURN = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Hashes worked out at once, so that their states stay in the processor's cache, and weights handed on at once.
HASHES_AT_ONCE, WEIGHTS_AT_ONCE = 1 << 17, 1 << 22


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a hash."""
    key = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_weight(u: Column) -> Column:
    return sum(((u >= c).cast("int") for c in POISSON[1:]), (u >= POISSON[0]).cast("int"))


def _md5_starts(words: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """(rows, heads): the first 32 bits of the MD5 of each row's padded text (rows, 16 words a block), in whose first words a head is filled in."""
    shape = len(words), len(heads)
    state = [np.full(shape, x, np.uint32) for x in _STATE]
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    blocks = words.shape[1] // 16
    for k in range(blocks):
        # A word is a column, as long as no head reaches into it.
        m = [words[:, i : i + 1] | heads[:, i] if i < heads.shape[1] else words[:, i : i + 1] for i in range(16 * k, 16 * k + 16)]
        a, b, c, d = (x.copy() for x in state)
        last = k == blocks - 1
        # The first word of the state is settled three steps before the end.
        for i in range(61 if last else 64):
            if i < 16:
                g = i
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                g = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                g = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                g = 7 * i % 16
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            np.add(f, a, out=f)
            np.add(f, m[g] + _ADD[i], out=f)
            np.left_shift(f, _TURN[i], out=t)
            np.right_shift(f, 32 - _TURN[i], out=f)
            np.bitwise_or(f, t, out=f)
            np.add(f, b, out=a)
            a, b, c, d = d, a, b, c
        if last:
            return np.add(state[0], b).byteswap()
        state = [x + y for x, y in zip(state, (a, b, c, d), strict=True)]
    raise ValueError("a text has at least one block")


def weights(uids: list[str | None], n: int, seed: int) -> np.ndarray:
    """(uids, n) int8: poisson_weight(uniform(seed, b, uid)) of the replicates b."""
    out = np.zeros((len(uids), n), np.int8)
    tails = [b"" if u is None else b":" + u.encode() for u in uids]
    cuts = [ceil(c * 2**32) for c in POISSON]
    low = 0
    while low < n:
        # Replicates of as many digits: their heads have one length.
        high = min(n, 10 ** len(str(low)))
        heads = [f"{seed}:{b}".encode() for b in range(low, high)]
        size = len(heads[0])
        of = np.array([(size + len(t) + 9 + 63) // 64 for t in tails], np.int64)
        for blocks in np.unique(of).tolist():
            rows = np.flatnonzero(of == blocks)
            raw = b"".join((bytes(size) + t + b"\x80").ljust(64 * blocks - 8, b"\0") + (8 * (size + len(t))).to_bytes(8, "little") for t in (tails[i] for i in rows.tolist()))
            words = np.frombuffer(raw, "<u4").reshape(len(rows), 16 * blocks)
            for h in range(0, len(heads), HASHES_AT_ONCE):
                part = heads[h : h + HASHES_AT_ONCE]
                filled = np.frombuffer(b"".join(x.ljust(-(-size // 4) * 4, b"\0") for x in part), "<u4").reshape(len(part), -1)
                step = max(1, HASHES_AT_ONCE // len(part))
                for at in range(0, len(rows), step):
                    u = _md5_starts(words[at : at + step], filled)
                    out[rows[at : at + step], low + h : low + h + len(part)] = sum((u >= c).view(np.int8) for c in cuts)
        low = high
    return out


def replicates(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Adds w, the row's weights in the replicates 0..n-1; rows keep their order."""
    names = [*rows.columns, "w"]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, WEIGHTS_AT_ONCE // max(n, 1))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                uid = b.column(b.num_columns - 1).dictionary_encode(null_encoding="encode")
                w = weights(uid.dictionary.to_pylist(), n, seed)[np.asarray(uid.indices)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * n), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=names)

    return rows.withColumn("__uid", F.col("uid").cast("string")).mapInArrow(draw, StructType([*rows.schema.fields]).add("w", ArrayType(ByteType())))


def _areas(rows: DataFrame, n: int) -> DataFrame:
    """Of rows (p, y, w) sorted by p and y in each partition, no score but the outer ones of a partition standing in others: for each partition, replicate b and span of scores, pos and neg, the weights of either class, and twice, the pairs in the right order, doubled, ties as one.

    The first and the last score are spans of their own (inner false), whose pairs are still to be counted; all between are one span, at its least score.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros = lambda: np.zeros(n, np.int64)
        spans, open_, low = [], None, None
        above, below, twice = zeros(), zeros(), zeros()
        for b in batches:
            if not b.num_rows:
                continue
            p, y = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            w = np.asarray(b.column(2).flatten()).reshape(len(p), n)
            ends = np.append(np.flatnonzero((p[1:] != p[:-1]) | (y[1:] != y[:-1])) + 1, len(p)).tolist()
            start = 0
            for end in ends:
                at = float(p[start])
                if open_ is None or not (open_[0] == at or open_[0] != open_[0] and at != at):
                    if open_ is not None and not spans:
                        spans.append(open_)
                    elif open_ is not None:
                        low = open_[0] if low is None else low
                        twice += open_[1] * (2 * below + open_[2])
                        above += open_[1]
                        below += open_[2]
                    open_ = (at, zeros(), zeros())
                open_[1 if y[start] else 2][:] += w[start] if end == start + 1 else w[start:end].sum(axis=0, dtype=np.int64)
                start = end
        if open_ is not None:
            spans.append(open_)
        found = [(at, False, pos, neg, zeros()) for at, pos, neg in spans] + ([(low, True, above, below, twice)] if low is not None else [])
        for at, inner, pos, neg, pairs in found:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at)), pa.array(np.full(n, inner)), pa.array(np.arange(n, dtype=np.int32)), pa.array(pos), pa.array(neg), pa.array(pairs.astype(np.float64))], names=["p", "inner", "b", "pos", "neg", "twice"])

    return rows.select("p", "y", "w").mapInArrow(add, "p double, inner boolean, b int, pos long, neg long, twice double")


def bootstrap_map(models: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """b, model, map of models (model, uid, cls, y, p)."""
    drawn = replicates(models, n, seed).select(*models.columns, F.posexplode("w").alias("b", "w")).filter("w > 0")
    per = average_precision(drawn, ["b", "model", "cls"], F.col("w").cast("int"), many=True)
    return per.groupBy("b", "model").agg(F.avg("ap").alias("map"))


def map_interval(replicated: DataFrame, alpha: float = 0.05) -> DataFrame:
    """model, lo, hi of the finite replicates."""
    q = F.percentile("map", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return replicated.filter("map is not null").groupBy("model").agg(q.alias("q")).select("model", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def paired_delta(replicated: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """One row: delta_lo, delta_hi and worse, the share of replicates in which b isn't better than a."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("map")))
    gap = replicated.groupBy("b").agg((of(b) - of(a)).alias("d")).filter("d is not null")
    q = F.percentile("d", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return gap.agg(q.alias("q"), F.avg((F.col("d") <= 0).cast("double")).alias("worse")).select(F.col("q")[0].alias("delta_lo"), F.col("q")[1].alias("delta_hi"), "worse")


def bootstrap_auroc(screening: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """b, auroc of screening (uid, threat 0 or 1, score); no row of a replicate whose rows are of one class, or of one without rows.

    Equal scores are spread over partitions by a hash of the uid. What is gathered is three rows a partition and replicate, whatever the rows.
    """
    rows = screening.select("uid", F.col("threat").cast("int").alias("y"), F.col("score").cast("double").alias("p")).filter("y is not null and p is not null")
    laid = rows.repartitionByRange(width(rows.sparkSession), "p", F.xxhash64("uid")).sortWithinPartitions("p", "y")
    pos, neg = F.col("pos"), F.col("neg")
    span = _areas(replicates(laid, n, seed), n).groupBy("b", "p", "inner").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("twice").alias("twice"))
    lower = Window.partitionBy("b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    right = pos.cast("double") * F.coalesce(F.col("lower"), F.lit(0)) + F.when(F.col("inner"), F.col("twice")).otherwise(pos.cast("double") * neg) / 2
    every = span.withColumn("lower", F.sum("neg").over(lower)).groupBy("b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(right).alias("right"))
    return every.filter("pos > 0 and neg > 0").select("b", (F.col("right") / (pos.cast("double") * neg)).alias("auroc"))


def auroc_interval(screening: DataFrame, n: int, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row: lo, hi of the AUROC of screening (uid, threat, score)."""
    per = bootstrap_auroc(screening, n, seed)
    return per.agg(F.percentile("auroc", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q")).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
