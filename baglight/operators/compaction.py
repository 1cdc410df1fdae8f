"""Consolidation of very many tiny files into few files of a chosen size.

The committed source files' lines are parsed, the newest complete record of each key is kept, and
the records are laid along a Hilbert curve over their folder, number and time, so that records read
together lie together. Exact running sums of bytes in curve order give every record its file: the
files are equal in size, near the target and never above the limit. A range shuffle brings each
file to one task, the files are written by Spark's committer (a lost task is simply run again), and
the digests of the rows before and after are compared.

Defined cases: a file is uncommitted when a segment of its path begins with `_` or `.`, or its name
ends in `.tmp`; a null path counts as committed; a null time is the oldest; null and blank payloads,
blank lines and lines that aren't one JSON object give no record; both line ends separate lines; of
several records of a key the one with the latest time, then the largest file_id, then the last line
wins; cache_ok may be a JSON boolean or a string of one, anything else is null; a record without key
is no record; one record above the limit gets a file of its own and is the only way past the limit;
an empty table gives an empty store.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baglight.functions.curve import hilbert_code
from baglight.functions.stage import stage_path, width
from baglight.operators.rows import running_sum

STORED = "uid string, img_path string, seg_path string, cache_ok boolean, file_id long"


def uncommitted(path: Column) -> Column:
    return F.coalesce(path.rlike(r"(^|/)[_.]") | path.endswith(".tmp"), F.lit(False))


def complete_records(files: DataFrame) -> DataFrame:
    """uid, img_path, seg_path, cache_ok, file_id, written_at, line of every complete record of a committed file."""
    lines = files.filter(~uncommitted(F.col("file_path"))).select("file_id", "written_at", F.posexplode(F.split("payload", r"\r\n|\n|\r")).alias("line", "text"))
    # In brackets, text after the first value makes the whole invalid or a list of two.
    parsed = lines.filter(F.trim("text") != "").withColumn("v", F.expr(r"try_parse_json(concat('[', ltrim('﻿', text), ']'))"))
    one = parsed.filter(F.col("v").isNotNull() & F.expr("variant_get(v, '$[1]', 'variant') is null"))
    return one.select(
        F.expr("try_variant_get(v, '$[0].uid', 'string')").alias("uid"),
        F.expr("try_variant_get(v, '$[0].img_path', 'string')").alias("img_path"),
        F.expr("try_variant_get(v, '$[0].seg_path', 'string')").alias("seg_path"),
        F.expr("try_cast(lower(trim(try_variant_get(v, '$[0].cache_ok', 'string'))) as boolean)").alias("cache_ok"),
        "file_id",
        "written_at",
        "line",
    ).filter("uid is not null")


def newest_records(files: DataFrame) -> DataFrame:
    """The record of each uid from the committed file written last. A hot uid is cut to one row a task before the shuffle."""
    order = Window.partitionBy("uid").orderBy(F.col("written_at").desc_nulls_last(), F.col("file_id").desc_nulls_last(), F.col("line").desc(), "img_path", "seg_path", "cache_ok")
    return complete_records(files).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n", "line")


def digest(rows: DataFrame, line: str) -> tuple:
    """Bytes, count and two order-free digests of a table of lines."""
    h = F.xxhash64(line)
    r = rows.agg(F.sum(F.octet_length(line) + 1).alias("b"), F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s")).head()
    return r.b or 0, r.n, r.x or 0, r.s or 0


@dataclass
class Store:
    path: str
    rows: DataFrame
    files: int


def compact(files: DataFrame, target_bytes: int, max_bytes: int, path: str | None = None) -> Store:
    """Writes the newest records as JSON lines into few files below path and checks that none is lost or repeated."""
    spark: SparkSession = files.sparkSession
    path = path or stage_path(spark, "store")
    record = newest_records(files)
    stored = [F.col(c.split()[0]) for c in STORED.split(", ")]
    folder = F.regexp_extract("img_path", r"(?i)class(?:%20|[^0-9])*([0-9]{1,9})", 1)
    number = F.regexp_extract("uid", r"(\d{1,9})\D*$", 1)
    day = F.datediff("written_at", F.lit("1970-01-01"))
    line = record.withColumn("line", F.to_json(F.struct(*stored))).withColumn("bytes", F.octet_length("line") + 1)
    code = hilbert_code(
        F.coalesce(folder.try_cast("int"), F.lit(0)) % 65536,
        F.coalesce(number.try_cast("int"), F.lit(0)) % 65536,
        F.pmod(F.coalesce(day, F.lit(0)), F.lit(65536)),
    )
    # The line is all that goes on: the columns are in it.
    rest = running_sum(line.select("uid", code.alias("code"), "line", "bytes"), [F.col("code"), F.col("uid")], F.col("bytes"), "upto")
    before = digest(rest._rows, "line")
    total = before[0]
    if not total:
        return Store(path, spark.createDataFrame([], STORED), 0)
    # A file is filled up to `full` and takes the record that crosses it; longer records lie alone.
    count = -(-total // target_bytes)
    full = -(-total // count)
    long = F.col("bytes") > max_bytes - full
    file = F.when(long, F.lit(count) + F.col("upto")).otherwise(F.floor((F.col("upto") - 1) / full))
    tasks = max(1, min(count, 4 * width(spark)))
    placed = rest.withColumn("file", file).withColumn("to", F.least(F.floor(F.col("upto") * tasks / (total + 1)), F.lit(tasks - 1)).cast("int"))
    placed = placed.withColumn("to", F.when(long, F.col("to")).otherwise(F.floor(F.col("file") * tasks / count).cast("int")))
    one_task = placed.repartitionById(tasks, F.col("to")).sortWithinPartitions("file", "code", "uid")
    one_task.select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)
    after = digest(spark.read.schema("value string").text(path), "value")
    if before != after:
        raise RuntimeError(f"the store differs from its source: {before} and {after}")
    return Store(path, spark.read.schema(STORED).json(path).select(*stored), count)


def file_sizes(store: Store) -> DataFrame:
    """file, bytes, rows of each file of a store."""
    spark = store.rows.sparkSession
    if not store.files:
        return spark.createDataFrame([], "file string, bytes long, rows long")
    read = spark.read.schema("value string").text(store.path)
    return read.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
