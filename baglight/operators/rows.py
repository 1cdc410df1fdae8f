"""Operators on rows of any table: latest versions, running sums in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baglight.functions.stage import stage, width


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The current row of each key: the one with the latest time.

    Null times come before all others. Rows with the same time are told apart by their values,
    so exact copies leave one row and a tie always gives the same row. Null keys give no row.
    The rank filter is pushed below the shuffle by Spark, so a hot key arrives as one row a task.
    """
    rest = [F.col(f"`{c}`").desc_nulls_last() for c in df.columns if c not in (key, at)]
    order = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), *rest)
    return df.filter(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


#: Steps of a score in one range of sums_from_top; a power of two, so that ranges keep the order exactly.
STEPS = 4096


def score_range(score: Column) -> Column:
    """The number of a score's range: ranges are in the scores' order, NaN above all. Scores beyond about 260,000 share the outer ranges."""
    x = F.greatest(F.least(score.cast("double") * STEPS, F.lit(float(1 << 30))), F.lit(float(-(1 << 30))))
    return F.when(F.isnan(score.cast("double")), F.lit(1 << 30)).otherwise(F.floor(x)).cast("long")


def sums_from_top(df: DataFrame, by: list[str], score: str, sums: dict[str, Column], then: tuple[Column, ...] = ()) -> DataFrame:
    """Adds to each row the sums of columns over its group's rows from the highest score down to it; `then` orders equal scores.

    Groups are few and may hold all rows, so no window runs over a group: scores are cut into fixed
    ranges, windows run inside a range, and each range begins with the sum of those above, of which
    a group has as many as ranges. Rows with a null in `by` are left out.
    """
    values = {f"__v{i}": c for i, c in enumerate(sums.values())}
    rows = df.withColumns({"__b": score_range(F.col(score)), **values})
    per = rows.groupBy(*by, "__b").agg(*[F.sum(v).alias(v) for v in values])
    above = Window.partitionBy(*by).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(*by, "__b", *[F.coalesce(F.sum(v).over(above), F.lit(0)).alias(f"{v}_from") for v in values])
    within = Window.partitionBy(*by, "__b").orderBy(F.desc(score), *then).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(starts, [*by, "__b"])
    return out.select(*df.columns, *[(F.col(f"{v}_from") + F.sum(v).over(within)).alias(name) for v, name in zip(values, sums, strict=True)])


def greatest_below(df: DataFrame, by: list[str], score: str, value: str, name: str, then: tuple[Column, ...] = ()) -> DataFrame:
    """Adds the greatest value over a group's rows from this row down to the lowest score, by ranges as in sums_from_top."""
    rows = df.withColumn("__b", score_range(F.col(score)))
    below = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by, "__b").agg(F.max(value).alias("__m")).select(*by, "__b", F.max("__m").over(below).alias("__m"))
    within = Window.partitionBy(*by, "__b").orderBy(F.desc(score), *then).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = rows.join(ends, [*by, "__b"])
    return out.select(*df.columns, F.greatest(F.max(value).over(within), F.col("__m")).alias(name))


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """Adds `name`, the sum of value over all rows up to this one in the given order, ties broken by the order itself.

    Range partitions are sorted and summed on their own; only one sum a partition (as many rows as
    partitions) is gathered to give each partition its start. No task sees the whole table.
    An order that isn't total gives a valid but arbitrary order among equal rows. An empty table stays empty.
    """
    n = partitions or width(df.sparkSession)
    cols = df.columns
    laid = df.withColumn("__v", value).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    keys = {f"__k{i}": c for i, c in enumerate(order)}
    laid = stage(laid.withColumns(keys), "laid")
    sums = laid.groupBy("__part").agg(F.sum("__v").alias("__s"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    within = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = laid.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.sum("__v").over(within))
    out = out.select(*cols, name)
    out._rows = laid.select(*cols)  # the rows without the sum, as staged, for a caller that needs them again
    return out
