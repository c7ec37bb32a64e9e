"""Graphs as DataFrames: canonical edges (u < v), the symmetric view, degrees and totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(pairs: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Distinct (u, v) with u < v; self loops and nulls go."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, from one pass over the edges."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))
    return edges.select(ends.alias("e")).select("e.src", "e.dst")


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))


@dataclass
class Graph:
    """edges: canonical (u, v, ...); nodes: (node[, side]) with isolated nodes, if any are known."""

    edges: DataFrame
    nodes: DataFrame | None = None

    @property
    def adj(self) -> DataFrame:
        return symmetric(self.edges)

    @property
    def degree(self) -> DataFrame:
        return degrees(self.adj)

    def all_nodes(self) -> DataFrame:
        return self.nodes if self.nodes is not None else self.adj.select(F.col("src").alias("node")).distinct()

    def totals(self) -> DataFrame:
        """n, m and edges_per_node (edges over nodes; 0 without nodes)."""
        n = self.all_nodes().agg(F.count(F.lit(1)).alias("n"))
        m = self.edges.agg(F.count(F.lit(1)).alias("m"))
        return n.join(F.broadcast(m)).select("n", "m", F.coalesce(F.try_divide(F.col("m"), F.col("n")), F.lit(0.0)).alias("edges_per_node"))

    def size(self) -> tuple[int, int]:
        row = self.totals().first()
        return row["n"], row["m"]

    def induced(self, nodes: DataFrame) -> Graph:
        """Subgraph of a node set (node)."""
        edges = self.edges
        for end in ("u", "v"):
            edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
        return Graph(edges, nodes.select("node"))

    def without(self, pairs: DataFrame) -> Graph:
        return Graph(self.edges.join(pairs.select("u", "v"), ["u", "v"], "left_anti"), self.nodes)


def non_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return pairs.join(edges.select("u", "v"), ["u", "v"], "left_anti")


def cross_side(u: Column, v: Column) -> Column:
    """Whether ids of a two-sided view stand on different sides (even and odd)."""
    return F.pmod(u, F.lit(2)) != F.pmod(v, F.lit(2))


def cross_letter(u: Column, v: Column) -> Column:
    """Whether names begin with different letters, as ids of two sides do that carry their side in front."""
    return F.substring(u.cast("string"), 1, 1) != F.substring(v.cast("string"), 1, 1)


def overview(graph: Graph) -> str:
    """One line on a graph."""
    row = graph.totals().first()
    return f"{row['n']} nodes, {row['m']} edges, {row['edges_per_node']:.2f} edges a node"


def degree_bins(degree: DataFrame, bins: int = 25) -> DataFrame:
    """(node, deg, bin): the last of ``bins`` log-spaced edges, from 1 to the power of ten below the largest
    degree, that the degree reaches. With one power only, all edges are 1 and every node is in the last bin."""
    top = degree.agg(F.floor(F.log10(F.max("deg").cast("double"))).alias("stop"))
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.pow(F.lit(10.0), i * F.col("stop") / F.lit(float(bins - 1))))
    reached = F.size(F.filter(edges, lambda e: e <= F.col("deg") + 1e-9)) - 1
    return degree.join(F.broadcast(top)).select("node", "deg", reached.cast("long").alias("bin"))


def projection(edges: DataFrame, keep: str = "u", via: str = "v") -> DataFrame:
    """One-sided view of a two-sided graph: pairs of ``keep`` ids that share ``via`` ids, and how many."""
    e = edges.select(F.col(keep).alias("x"), F.col(via).alias("w"))
    pairs = e.alias("a").join(e.alias("b"), "w").where("a.x < b.x")
    return pairs.groupBy(F.col("a.x").alias("u"), F.col("b.x").alias("v")).agg(F.count(F.lit(1)).alias("weight"))


def filter_edges(graph: Graph, rho: float = 0.75) -> DataFrame:
    """The int(m * rho) edges with the largest least-end degree, ties by (u, v)."""
    d = graph.degree
    _, m = graph.size()
    e = graph.edges.select("u", "v").join(d.select(F.col("node").alias("u"), F.col("deg").alias("du")), "u").join(d.select(F.col("node").alias("v"), F.col("deg").alias("dv")), "v")
    return e.select("u", "v", F.least("du", "dv").alias("least_deg")).orderBy(F.desc("least_deg"), "u", "v").limit(int(m * rho))


def ranked(df: DataFrame, by: list[str], *order, name: str = "rk") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
