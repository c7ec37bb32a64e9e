"""Session plumbing shared by the corpus operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgesmith.functions.lineage import checkpoint_folder

#: With it, Spark removes a plan's shuffle files as soon as the plan has run.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Places for each shuffle partition: a key with more than one place's share of all rows is dealt over several.
PLACES = 4

#: A word is a run of bytes other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared checkpoint folder and read it back.

    The copy survives lost executors, so the shuffles behind it go at once. It is removed when the driver exits; its path is added to
    ``scratch``, if given, so that ``discard`` can remove it as soon as nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/edgesmith-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    atexit.register(_remove, spark, path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str], last: int = 0) -> None:
    """Remove the tables of ``scratch`` but for the ``last`` ones. All that was made of them must be written out."""
    while len(scratch) > last:
        _remove(spark, scratch.pop(0))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at exit
        return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_pack(rows: DataFrame, n_packs: int, key: str = "g") -> DataFrame:
    """rows dealt by their pack (or bucket) over as many partitions as hold a few each, so that tasks don't grow with the input."""
    return rows.repartition(max(partitions(rows.sparkSession), min(-(-n_packs // 2), 100_000)), key)


def salted(rows: DataFrame, key: str, spread: Column, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with ``salt``, and one row for each key and salt that they can have: _key, _salt.

    ``counts`` holds, written out, how many rows (n) each key has. A key gets as many salts as it has shares of all rows, so
    no place holds more than a share, whatever their number. Fewer keys than places have more than one, so these are broadcast.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    dealt = counts.select(F.col(key).alias("_key"), F.ceil(F.col("n") / F.lit(max(1.0, total / (PLACES * partitions(rows.sparkSession))))).alias("_salts"))
    hot = F.broadcast(dealt.where("_salts > 1"))
    out = rows.join(hot, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("salt", F.pmod(spread, F.coalesce("_salts", F.lit(1))))
    return out.drop("_key", "_salts"), dealt.select("_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_salt"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Total UTF-8 bytes of a text column: one column scan, one number to the driver."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0)
