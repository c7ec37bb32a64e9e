"""Candidate pairs of an edge list: python -m edgesmith EDGES OUT --budget N [--method M] [options of the method]."""

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from edgesmith.functions.lineage import cut
from edgesmith.operators.graph import Graph, overview
from edgesmith.plans.harness import BreadthFirst, GroupSearch, PersonalPageRank, RestartWalk, TruncatedWalk
from edgesmith.sources import files


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="edgesmith")
    p.add_argument("edges", help="whitespace separated text, # comments")
    p.add_argument("out", help="folder for u,v lines without a header")
    p.add_argument("--budget", type=int, required=True, help="most pairs to emit")
    p.add_argument("--damping", type=float, default=0.8, help="probability of walking on")
    p.add_argument("--keep", type=float, default=40, help="nodes remembered, times a node's share of the budget")
    p.add_argument("--epsilon", type=float, default=0.05, help="stop below this share of mass moved")
    p.add_argument("--method", default="walk", choices=["walk", "restart", "pagerank", "bfs", "groups", "forest", "common", "jaccard", "adamic_adar", "ensemble"])
    p.add_argument("--embedding", default="proximity", choices=["factor1", "factor2", "two_sided", "proximity"], help="vectors of groups and forest")
    p.add_argument("--dim", type=int, default=128, help="length of the vectors")
    for name in ("structure", "community"):
        p.add_argument(f"--{name}", action="store_true", help=f"group by {name}, too")
    p.add_argument("--groups", type=int, help="how many groups")
    p.add_argument("--bailout", type=float, default=0.5, help="share of training edges below which a cell is left, 0 for none")
    p.add_argument("--steps", type=int, default=1000, help="steps of the walk with restart")
    p.add_argument("--bipartite", action="store_true", help="only pairs of an even and an odd number")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    numbered, names = files.number_nodes(files.edges(spark, a.edges))
    graph = Graph(cut(numbered))
    print(overview(graph))
    each = -(-a.budget // max(1, graph.size()[0]))  # pairs a node
    made = {
        "walk": lambda: TruncatedWalk(graph, budget=a.budget, damping=a.damping, keep=a.keep, epsilon=a.epsilon, bipartite=a.bipartite),
        "restart": lambda: RestartWalk(graph, k=each, steps=a.steps, bipartite=a.bipartite),
        "pagerank": lambda: PersonalPageRank(graph, k=each, damping=a.damping),
        "bfs": lambda: BreadthFirst(graph, k=each, exclude_edges=True),
    }
    grouped = lambda: GroupSearch(graph, k=a.budget, method=a.method, embedding=a.embedding, dim=a.dim, structure=a.structure, community=a.community, groups=a.groups, bailout=a.bailout, bipartite=a.bipartite)
    found = made.get(a.method, grouped)().run()
    old = lambda c: names.select(F.col("id").alias(c), F.col("old_id").alias(f"_{c}"))
    files.write_pairs(found.join(old("u"), "u").join(old("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")), a.out)


if __name__ == "__main__":
    main()
