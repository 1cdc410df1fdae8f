"""Tables between the steps of an operator, in the folder that all executors share.

A written table survives the loss of an executor and cuts the lineage, so that a later
step never computes an earlier one again.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where none is set and all runs on this machine, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="baglight-")
        atexit.register(shutil.rmtree, made, True)
        spark.sparkContext.setCheckpointDir(f"file://{made}")
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/baglight/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go when it ends, instead of when the driver happens to collect its garbage.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """df, written to the shared folder and read again. With release, the shuffle files behind it are removed as soon as it is written."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    before = spark.conf.get(_RELEASE, None)
    if release:
        spark.conf.set(_RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Removes a staged table that no later plan reads."""
    path = getattr(df, "_stage_path", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
