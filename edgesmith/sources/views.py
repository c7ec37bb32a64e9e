"""Graph views over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgesmith.functions.lineage import cut
from edgesmith.operators.graph import Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_orders(spark: SparkSession, sf_dir: str, flag: str | None = "R") -> DataFrame:
    """(u, v, weight, ts): parts u < v returned from one order; how many orders, and the first date. Without a ``flag``,
    parts on any lines of one order."""
    lines = read(spark, sf_dir, "lineitem")
    lines = (lines if flag is None else lines.where(F.col("l_returnflag") == flag)).select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    pairs = lines.alias("a").join(lines.alias("b"), "o").where("a.p < b.p").select("o", F.col("a.p").alias("u"), F.col("b.p").alias("v"))
    dated = pairs.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), "o_orderdate"), "o")
    return dated.groupBy("u", "v").agg(F.count(F.lit(1)).alias("weight"), F.min("o_orderdate").alias("ts"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, ts): customer 2 * key and part 2 * key + 1, with the first date."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    both = orders.join(lines, "o_orderkey").select((2 * F.col("o_custkey")).alias("u"), (2 * F.col("l_partkey") + 1).alias("v"), "o_orderdate")
    return both.groupBy("u", "v").agg(F.min("o_orderdate").alias("ts"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, label), in doubles."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def part_graph(spark: SparkSession, sf_dir: str, flag: str | None = "R") -> Graph:
    """The one-sided graph, its edges cut from their lineage since every operator reads them often."""
    return Graph(cut(shared_orders(spark, sf_dir, flag)))


def purchase_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The two-sided graph with u < v, sides by parity."""
    e = purchases(spark, sf_dir)
    return Graph(cut(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "ts")))


SHARED_ORDERS = """
lr AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'),
gu AS (SELECT a.p AS u, b.p AS v, count(*) AS weight, min(o_orderdate) AS ts FROM lr a JOIN lr b ON a.o = b.o AND a.p < b.p JOIN orders ON o_orderkey = a.o GROUP BY ALL),
adj AS (SELECT u AS src, v AS dst FROM gu UNION ALL SELECT v, u FROM gu),
deg AS (SELECT src AS node, count(*) AS deg FROM adj GROUP BY src)"""

#: The same over all lines.
ALL_ORDERS = SHARED_ORDERS.replace("WHERE l_returnflag = 'R'", "")

PURCHASES = """
gb AS (SELECT 2 * o_custkey AS u, 2 * l_partkey + 1 AS v, min(o_orderdate) AS ts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""

PURCHASE_ADJ = PURCHASES + """,
adj AS (SELECT u AS src, v AS dst FROM gb UNION ALL SELECT v, u FROM gb),
deg AS (SELECT src AS node, count(*) AS deg FROM adj GROUP BY src)"""
