"""Node sets that grow from drawn nodes or along a walk, and the subgraph of a walk.

A set grows by whole neighbourhoods. Drawn nodes (or the places of a walk) have an order; a node is covered by the
first of these that is itself or a neighbour of it, and the set is all that is covered by the time it has the wanted
size: one join and one minimum, instead of a loop over nodes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgesmith.functions.lineage import cut
from edgesmith.functions.portable import digest
from edgesmith.operators.graph import Graph, canonical

MODES = ("nodes", "edges", "biased")


def grown(graph: Graph, order: DataFrame, size: int) -> DataFrame:
    """(node): nodes covered, in the order (node, r) of strings, until at least ``size`` are."""
    closed = graph.adj.unionByName(graph.all_nodes().select(F.col("node").alias("src"), F.col("node").alias("dst")))
    cover = cut(closed.join(order, closed["src"] == order["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("r").alias("r")))
    last = cover.orderBy("r", "node").limit(size).agg(F.max("r").alias("last"))
    return cover.join(F.broadcast(last)).where("r <= last").select("node")


def drawn(nodes: DataFrame, seed: int = 42, bag: int = 0) -> DataFrame:
    """(node, r): nodes in an order by digest."""
    return nodes.select("node", F.concat_ws("|", digest(seed, F.lit(bag), "node"), F.col("node").cast("string")).alias("r"))


def walk(graph: Graph, steps: int, seed: int = 42, bag: int = 0, biased: bool = False) -> list:
    """The places of one walker: from the first drawn node to the neighbour of the least digest of (step, place,
    neighbour); if ``biased``, to the one least often visited, then by digest. One row a step reaches the driver."""
    adj = cut(graph.adj)
    start = drawn(graph.all_nodes(), seed, bag).orderBy("r").first()
    path = [] if start is None else [start["node"]]
    used: dict = {}
    while path and len(path) <= steps:
        at = path[-1]
        used[at] = used.get(at, 0) + 1
        visits = F.lit(0)
        if biased:
            counts = F.create_map(*[F.lit(x) for pair in used.items() for x in pair])
            visits = F.coalesce(F.try_element_at(counts, F.col("dst")), F.lit(0))
        key = F.struct(visits.alias("visits"), digest(seed, F.lit(bag), F.lit(len(path)), F.lit(at), "dst").alias("key"), "dst")
        path.append(adj.where(F.col("src") == F.lit(at)).agg(F.min(key)["dst"]).first()[0])
    return path


def walk_subgraph(graph: Graph, steps: int, seed: int = 42) -> DataFrame:
    """(u, v): the edges that one walk of so many steps goes along."""
    path = walk(graph, steps, seed)
    return canonical(graph.edges.sparkSession.createDataFrame(list(zip(path, path[1:], strict=False)), "u long, v long"))


def bags(graph: Graph, count: int, share: float = 0.1, seed: int = 42, mode: str = "nodes", steps: int = 16) -> DataFrame:
    """(bag, node): node sets of at least a share of the nodes each, grown from drawn nodes, or along a walk of so many
    steps (``edges``, or ``biased`` to seldom visited nodes) and from drawn nodes where that is not enough."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    nodes = cut(graph.all_nodes().select("node"))
    size, out = max(1, math.ceil(share * nodes.count())), None
    for bag in range(count):
        order = drawn(nodes, seed, bag)
        if mode != "nodes":
            path = walk(graph, steps, seed, bag, mode == "biased")
            first = {node: f" {at:09d}" for at, node in reversed(list(enumerate(path)))}  # a space: before any digest
            early = graph.edges.sparkSession.createDataFrame(list(first.items()), "node long, early string")
            order = order.join(F.broadcast(early), "node", "left").select("node", F.coalesce("early", "r").alias("r"))
        part = grown(graph, order, size).select(F.lit(bag).alias("bag"), "node")
        out = part if out is None else out.unionByName(part)
    return out
