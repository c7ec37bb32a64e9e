"""Lineage cuts for iterative plans, in the shared folder that the cluster names, and numbering of whole tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder the context has; a private one only on a local master, where it is shared."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="edgesmith-")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into ``checkpoint_folder``. With spark.cleaner.referenceTracking.cleanCheckpoints, which a session
    sets at its start, a checkpoint's files go with the last plan on it."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint()


def row_numbers(df: DataFrame, *order) -> DataFrame:
    """rn (from 1) over the whole table without one task that sorts it: a range sort deals out parts, and the
    parts' counts (one row a part) give each its start."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_start"))
    inside = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return inside.join(F.broadcast(starts), "_part").withColumn("rn", F.col("_start") + F.col("_i")).drop("_part", "_n", "_start", "_i")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as compressed Parquet in ``checkpoint_folder``, and its path for ``forget``; the shuffles behind it go at once. For
    tables whose checkpoint, plain rows of Java objects, would be many times larger."""
    spark, path = df.sparkSession, f"{checkpoint_folder(df.sparkSession)}/edgesmith-{uuid.uuid4().hex}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    atexit.register(forget, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Remove a stored table that nothing reads any more."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at exit
        return
