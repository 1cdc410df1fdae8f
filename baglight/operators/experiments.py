"""Result tables and the registry of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baglight.functions.stage import drop_stage, stage


def upsert(old: DataFrame, new: DataFrame, key: str = "run") -> DataFrame:
    """old without the rows whose key is in new, then new; columns of either are kept."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without_runs(rows: DataFrame, name: str, prefix: str) -> DataFrame:
    return rows.filter(~((F.col("run") == name) | F.col("run").startswith(prefix)))


def headline(tables: list[DataFrame], value: str) -> DataFrame:
    """The tables in one, of each run the row of the last table, with its place by value."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("source", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("source"), F.desc_nulls_last(value)))
    kept = out.withColumn("n", last).filter("n = 1").drop("n", "source")
    return kept.withColumn("place", F.rank().over(Window.orderBy(F.desc_nulls_last(value))))  # a row a run


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, a, b of the keys (key, value) that one side lacks or that differ; null equals null."""
    j = a.withColumnRenamed("value", "a").withColumn("in_a", F.lit(True)).join(b.withColumnRenamed("value", "b").withColumn("in_b", F.lit(True)), "key", "full_outer")
    return j.filter(~(F.col("a").eqNullSafe(F.col("b")) & F.col("in_a").eqNullSafe(F.col("in_b")))).select("key", "a", "b")


def closure(deps: DataFrame) -> DataFrame:
    """name, dep with all dependencies of dependencies, each once; a cycle leads a name back to itself. Rounds double the length of the paths found."""
    now = stage(deps.select("name", "dep").distinct(), "closure")
    while True:
        longer = now.alias("x").join(now.alias("y"), F.col("x.dep") == F.col("y.name")).select("x.name", "y.dep")
        new = stage(now.union(longer).distinct(), "closure")
        done = new.count() == now.count()
        drop_stage(now)
        if done:
            return new
        now = new


def estimates(specs: DataFrame, deps: DataFrame) -> DataFrame:
    """name, minutes: a spec's own open minutes (name, minutes) and those of everything it needs, each counted once."""
    need = closure(deps).filter("name <> dep").join(specs.select(F.col("name").alias("dep"), "minutes"), "dep").groupBy("name").agg(F.sum("minutes").alias("more"))
    return specs.join(need, "name", "left").select("name", (F.col("minutes") + F.coalesce("more", F.lit(0))).alias("minutes"))


def seed_summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, mean, std (sample; null for one row), n."""
    return rows.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def speed(rows: DataFrame) -> DataFrame:
    """One row: factor, the median ratio of actual to estimated time, between 0.3 and 3."""
    r = F.median(F.expr("try_divide(actual, estimated)"))
    return rows.agg(F.coalesce(F.least(F.greatest(r, F.lit(0.3)), F.lit(3.0)), F.lit(1.0)).alias("factor"))


def states(specs: DataFrame, done: DataFrame, started: DataFrame) -> DataFrame:
    """name, state: 'done' with a result row, 'started' with a checkpoint, 'ready' if all it needs is done, else 'waiting'; specs: name, needs (array)."""
    ready = specs.select("name", F.explode("needs").alias("dep")).join(done.select(F.col("name").alias("dep")), "dep", "left_anti").select("name").distinct().withColumn("open", F.lit(True))
    flag = lambda df, c: df.select("name").distinct().withColumn(c, F.lit(True))
    j = specs.join(flag(done, "is_done"), "name", "left").join(flag(started, "is_started"), "name", "left").join(ready, "name", "left")
    return j.select("name", F.when(F.col("is_done"), "done").when(F.col("is_started"), "started").when(F.col("open"), "waiting").otherwise("ready").alias("state"))


def missing(specs: DataFrame, table: DataFrame) -> DataFrame:
    """Names of specs without a row (run) in a result table."""
    return specs.join(table.select(F.col("run").alias("name")), "name", "left_anti").select("name")


def top_cases(rows: DataFrame, group: str, value: str, n: int, key: str, largest: bool = True) -> DataFrame:
    """The n rows of each group with the largest (or smallest) value, ties by key."""
    order = F.desc_nulls_last(value) if largest else F.asc_nulls_last(value)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order, key))).filter(F.col("place") <= n)
