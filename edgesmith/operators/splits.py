"""Splits of a graph into rest, train, validation and test edges, and non-edges as negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgesmith.functions.lineage import row_numbers
from edgesmith.functions.portable import digest
from edgesmith.operators.graph import non_edges

FRACTIONS = (0.2, 0.1, 0.2)


def _sizes(m: int, fractions: tuple[float, float, float]) -> tuple[int, int, int]:
    return tuple(round(m * f) for f in fractions)


def _parts(df: DataFrame, m: int, fractions: tuple[float, float, float]) -> DataFrame:
    """rest, train, valid, then test takes all that is left, along column rn (from 1)."""
    train, valid, test = _sizes(m, fractions)
    rest = m - train - valid - test
    part = F.when(F.col("rn") <= rest, "rest").when(F.col("rn") <= rest + train, "train").when(F.col("rn") <= rest + train + valid, "valid").otherwise("test")
    return df.withColumn("part", part)


def static_split(edges: DataFrame, fractions: tuple[float, float, float] = FRACTIONS, seed: int = 42) -> DataFrame:
    """(u, v, part): edges in shuffled order, cut at half-even rounded sizes."""
    e = edges.select("u", "v", digest(seed, "u", "v").alias("key"))
    return _parts(row_numbers(e, "key", "u", "v"), e.count(), fractions).select("u", "v", "part")


def temporal_split(edges: DataFrame, fractions: tuple[float, float, float] = FRACTIONS, ts: str = "ts") -> DataFrame:
    """(u, v, part): the latest edges are the test."""
    e = edges.select("u", "v", ts)
    return _parts(row_numbers(e, ts, "u", "v"), e.count(), fractions).select("u", "v", "part")


def file_order_split(rows: DataFrame, fractions: tuple[float, float, float] = FRACTIONS) -> DataFrame:
    """(u, v, part) from (rn, u, v): repeated pairs keep their first row, and the row numbers count the
    repeats, so later parts grow by them."""
    first = rows.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("rn").alias("rn"))
    return _parts(first, first.count(), fractions).select("u", "v", "part")


def train_graph(split: DataFrame) -> DataFrame:
    """What selectors may see: all but the test edges."""
    return split.where("part <> 'test'").select("u", "v")


def touching(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs both of whose ends have an edge: the others name nodes that a selector can't see."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    for end in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return pairs.select("u", "v")


def overlap(split: DataFrame) -> DataFrame:
    """(a, b, n): how many pairs, in either orientation, two parts of a split share; no row where they are disjoint."""
    pairs = split.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "part").groupBy("u", "v").agg(F.sort_array(F.collect_set("part")).alias("parts")).where(F.size("parts") > 1)
    met = pairs.select(F.posexplode("parts").alias("i", "a"), "parts")
    met = met.select("a", F.explode(F.slice("parts", F.col("i") + 2, F.size("parts"))).alias("b"))
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def presplit(arrays: DataFrame, edges_of: str = "train") -> tuple[DataFrame, DataFrame]:
    """(edges, hidden) of given parts (split, u, v): distinct pairs, the hidden without edges and without nodes that have none."""
    edges = arrays.where(F.col("split") == edges_of).select("u", "v").distinct()
    hidden = non_edges(arrays.where(F.col("split") != edges_of).select("u", "v").distinct(), edges)
    return edges, touching(hidden, edges)


def sample_nodes(nodes: DataFrame, k: int, seed: int = 42) -> DataFrame:
    return nodes.select("node", digest(seed, "node").alias("key")).orderBy("key", "node").limit(k).select("node")


def negatives(edges: DataFrame, n: int, count: int, seed: int = 42, spare: float = 2.0) -> DataFrame:
    """At most ``count`` distinct non-edges between node positions 1..n of the ascending node ids.

    Draw i takes two positions from the digests of (seed, i, 0) and (seed, i, 1); self pairs, repeats and
    edges go; the earliest draws stay.
    """
    spark = edges.sparkSession
    pick = lambda side: F.pmod(F.conv(F.substring(digest(seed, "id", F.lit(side)), 1, 7), 16, 10).cast("long"), F.lit(n)) + 1
    draws = spark.range(int(count * spare)).select("id", pick(0).alias("a"), pick(1).alias("b")).where("a <> b")
    nodes = row_numbers(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node")
    named = draws.join(nodes.select(F.col("rn").alias("a"), F.col("node").alias("x")), "a").join(nodes.select(F.col("rn").alias("b"), F.col("node").alias("y")), "b")
    pairs = named.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.min("id").alias("id"))
    return non_edges(pairs, edges).orderBy("id").limit(count).select("u", "v")
