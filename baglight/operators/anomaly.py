"""Nearest-neighbour anomaly scores and robust standardisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baglight.functions.stage import width

#: A bank at most this large is broadcast; a larger one is scored in blocks.
BANK_BYTES = 64 << 20


def robust_fit(rows: DataFrame, value: str) -> DataFrame:
    """One row: centre, spread: the median and 1.4826 times the median absolute deviation of finite values.

    No values give (0, 1); a deviation below 1e-6 is replaced by the standard deviation plus 1e-6.
    """
    v = F.col(value).cast("double")
    x = rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(v.alias("x"))
    mid = x.agg(F.median("x").alias("m"), F.stddev_pop("x").alias("sd"))
    dev = x.join(F.broadcast(mid.select("m"))).agg((F.median(F.abs(F.col("x") - F.col("m"))) * 1.4826).alias("mad"))
    spread = F.when(F.col("mad") < 1e-6, F.col("sd") + 1e-6).otherwise(F.col("mad"))
    return mid.join(dev).select(F.coalesce("m", F.lit(0.0)).alias("centre"), F.coalesce(spread, F.lit(1.0)).alias("spread"))


def robust_z(rows: DataFrame, value: str, fit: DataFrame | None = None) -> DataFrame:
    """Adds z by a fit of other rows or of these."""
    f = robust_fit(rows, value) if fit is None else fit
    return rows.join(F.broadcast(f)).withColumn("z", (F.col(value) - F.col("centre")) / F.col("spread")).drop("centre", "spread")


def nearest(rows: DataFrame, bank: DataFrame, key: str, vector: str) -> DataFrame:
    """key, distance to the nearest row of the bank (bank_id, vector), not counting a row with the same id.

    The bank is a chosen sample. It is cut into blocks of at most BANK_BYTES, each block meets the
    rows in one pass of matrix products, and the least distance over the blocks is kept.
    """
    size = bank.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).head()
    if not size.n:
        return rows.select(key, F.lit(None).cast("double").alias("distance"))
    blocks = max(1, -(-size.n * size.d * 8 // BANK_BYTES))
    spark = rows.sparkSession
    out = None
    for i in range(blocks):
        part = bank if blocks == 1 else bank.filter(F.pmod(F.xxhash64("bank_id"), F.lit(blocks)) == i)
        own = part.select("bank_id", vector).toPandas()  # at most about BANK_BYTES
        if own.empty:
            continue
        shared = spark.sparkContext.broadcast((own["bank_id"].to_numpy(), np.stack(own[vector].to_numpy()).astype(np.float64)))

        def score(frames, shared=shared):
            ids, b = shared.value
            norm = (b * b).sum(axis=1)
            for f in frames:
                if len(f):
                    a = np.stack(f[vector].to_numpy()).astype(np.float64)
                    d = np.maximum((a * a).sum(axis=1)[:, None] + norm - 2 * a @ b.T, 0)
                    d[f[key].to_numpy()[:, None] == ids[None, :]] = np.inf
                    near = d.argmin(axis=1)
                    # The nearest is found by products; its distance is taken from the difference, which loses no digits.
                    exact = np.sqrt(((a - b[near]) ** 2).sum(axis=1))
                    yield pd.DataFrame({key: f[key], "distance": np.where(np.isfinite(d.min(axis=1)), exact, np.nan)})

        scored = rows.select(key, vector).mapInPandas(score, f"`{key}` long, distance double").withColumn("distance", F.nanvl("distance", F.lit(None).cast("double")))
        out = scored if out is None else out.union(scored)
    return out if blocks == 1 else out.groupBy(key).agg(F.min("distance").alias("distance"))


def top_mean(cells: DataFrame, k: int = 10) -> DataFrame:
    """uid, score_max, score_top: highest and mean of the k highest values of cells (uid, v). The rank is cut before the shuffle."""
    n = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("v")))
    return cells.filter("v is not null").withColumn("n", n).filter(F.col("n") <= k).groupBy("uid").agg(F.max("v").alias("score_max"), F.avg("v").alias("score_top"))


def masked_max(cells: DataFrame) -> DataFrame:
    """uid, score: the highest value outside the mask g."""
    return cells.groupBy("uid").agg(F.max(F.when(F.col("g") <= 0, F.col("v"))).alias("score"))


def gauss_weights(sigma: float) -> list[float]:
    radius = max(1, round(3 * sigma))
    w = [float(np.exp(-0.5 * (i / sigma) ** 2)) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def blur(maps: DataFrame, h: int, w: int, sigma: float = 1.0) -> DataFrame:
    """Smooths cells (uid, r, c, v) of h x w maps, edges repeated: one row a map, both passes on many maps at once. Maps must be whole."""
    weights = np.array(gauss_weights(sigma))
    radius = len(weights) // 2

    @F.pandas_udf("array<double>")
    def smooth(arrays: pd.Series) -> pd.Series:
        m = np.stack(arrays.to_numpy()).reshape(-1, h, w)
        for axis in (1, 2):
            edge = np.pad(m, [(radius, radius) if i == axis else (0, 0) for i in range(3)], mode="edge")
            m = sum(k * np.take(edge, range(i, i + m.shape[axis]), axis=axis) for i, k in enumerate(weights))
        return pd.Series(list(m.reshape(len(m), -1)))

    place = (F.col("r") * w + F.col("c")).alias("i")
    grid = maps.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct(place, "v"))), lambda x: x.v).alias("a"))  # h * w cells a map
    done = grid.select("uid", F.posexplode(smooth("a")).alias("i", "v"))
    return done.select("uid", F.floor(F.col("i") / w).cast("int").alias("r"), (F.col("i") % w).cast("int").alias("c"), "v")


def random_subsample(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows, the first by a hash of the key: a top-k of all rows, the same whatever the partitions."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k)


def k_centre(bank: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """key, step: greedy k-centre choice, from the least key on, always the row farthest from those chosen (the least key of equals).

    Each step is one pass that keeps every row's distance to its nearest choice; only the farthest row comes to the driver.
    """
    spark = bank.sparkSession
    rows = bank.select(key, vector).repartition(width(spark)).persist()
    chosen = [rows.orderBy(key).head()] if k else []
    if chosen == [None]:
        chosen = []
    while chosen and len(chosen) < k:
        centres = spark.sparkContext.broadcast(np.array([c[vector] for c in chosen], np.float64))

        def farthest(frames, centres=centres):
            best = None
            for f in frames:
                if len(f):
                    a = np.stack(f[vector].to_numpy()).astype(np.float64)
                    d = np.min([((a - c) ** 2).sum(axis=1) for c in centres.value], axis=0)
                    i = max(range(len(f)), key=lambda i: (d[i], -f[key].iloc[i]))
                    if best is None or (d[i], -f[key].iloc[i]) > (best[0], -best[1]):
                        best = (float(d[i]), int(f[key].iloc[i]))
            if best:
                yield pd.DataFrame({"d": [best[0]], key: [best[1]]})

        far = rows.mapInPandas(farthest, f"d double, `{key}` long").orderBy(F.desc("d"), key).head()  # one row a task
        if far is None or far.d <= 0:
            break
        chosen.append(rows.filter(F.col(key) == far[key]).head())
    out = spark.createDataFrame([(int(c[key]), i) for i, c in enumerate(chosen)], f"`{key}` long, step int")
    rows.unpersist()
    return out


def dilate(cells: DataFrame, value: str, reach: int = 1) -> DataFrame:
    """Cells (uid, r, c, ...) with the greatest value of all cells at most `reach` away, diagonals included: each cell is sent to its neighbours, and only maxima are shuffled."""
    shift = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    sent = cells.select("uid", "r", "c", F.col(value).alias("__v")).withColumn("dr", shift).withColumn("dc", shift)
    top = sent.select("uid", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "__v").groupBy("uid", "r", "c").agg(F.max("__v").alias("__v"))
    return cells.drop(value).join(top, ["uid", "r", "c"]).withColumnRenamed("__v", value)


def clutter_fit(cells: DataFrame) -> DataFrame:
    """robust_fit over the cells (v, g) outside the mask."""
    return robust_fit(cells.filter("g <= 0"), "v")
