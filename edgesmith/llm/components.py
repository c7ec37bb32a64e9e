"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), the last few links at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Most links (16 bytes each) that the driver joins itself; more go by rounds until so few are left.
HELD = 1 << 18


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, ascending, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (apart := up[i] != up[j]).any():
        x, y = up[i[apart]], up[j[apart]]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != up[up]).any():
            up = up[up]
    return nodes, nodes[up]


def components(links: DataFrame, scratch: list[str] | None = None, held: int = HELD) -> DataFrame:
    """(node, label) for every node of the (a, b) links: the label is the component's least node.

    Every round is written to the checkpoint folder, and the round before it removed; only a count
    and a checksum reach the driver, and the links as soon as they are at most ``held``. The last round's path is added to ``scratch``.
    """
    spark, rounds = links.sparkSession, []
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rounds)
    state = _state(edges)
    while state[0] > held:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), rounds)
        discard(spark, rounds, last=1)
        now = _state(edges)
        if now == state:
            break
        state = now
    if state[0] <= held:
        rows = edges.toArrow()
        node, label = joined(*(rows.column(c).to_numpy().astype(np.int64) for c in ("a", "b")))
        rows = spark.createDataFrame(pa.table([node, label], ["node", "label"]), "node long, label long")
        # written like a round, so that plans on it don't carry the rows
        stars = materialise(rows, rounds)
        discard(spark, rounds, last=1)
    if scratch is not None:
        scratch += rounds
    if state[0] <= held:
        return stars
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
