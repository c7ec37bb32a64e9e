"""Selectors behind one interface, and the benchmark that runs and records them.

A selector's ``run`` gives (u, v); ``n_scanned`` is how many distinct pairs it looked at, ``params`` what it was
given. The harness hides test edges, runs each selector for budgets of h times their number, and records metrics.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgesmith.functions.lineage import cut
from edgesmith.operators import graph as G
from edgesmith.operators import grouped, knn, lsh, metrics, models, scores, search, splits, walkrank
from edgesmith.sources import files


class Selector(ABC):
    """Emits candidate pairs of a graph."""

    def __init__(self, graph: G.Graph, **params):
        self.graph, self.params, self.found = graph, params, None

    @abstractmethod
    def select(self) -> DataFrame:
        """(u, v), any orientation."""

    @property
    def name(self) -> str:
        return type(self).__name__

    def run(self) -> DataFrame:
        self.found = cut(G.canonical(self.select()))
        return self.found

    def n_scanned(self) -> int:
        return (self.found if self.found is not None else self.run()).count()


class TruncatedWalk(Selector):
    """params: budget, damping, epsilon, keep, bipartite."""

    def select(self) -> DataFrame:
        return walkrank.TruncatedPageRank(self.graph, **self.params).run()


class BreadthFirst(Selector):
    """params: k, max_depth, exclude_edges."""

    def select(self) -> DataFrame:
        return search.bfs_candidates(self.graph, self.graph.all_nodes(), **self.params).select(F.col("q").alias("u"), "v")


class RestartWalk(Selector):
    """params: k, steps, restart, bipartite."""

    def select(self) -> DataFrame:
        p = {"steps": 1000, "restart": 0.1, "bipartite": False} | self.params
        visits = walkrank.restart_walks(self.graph, self.graph.all_nodes(), p["steps"], p["restart"])
        return walkrank.walk_candidates(self.graph, visits, p["k"], p["bipartite"]).select(F.col("q").alias("u"), "v")


class PersonalPageRank(Selector):
    """params: k, damping, iterations."""

    def select(self) -> DataFrame:
        return walkrank.pagerank(self.graph, self.graph.all_nodes(), **self.params).select(F.col("q").alias("u"), "v")


class Neighbourhood(Selector):
    """params: by (common, adamic_adar or jaccard), k."""

    def select(self) -> DataFrame:
        return scores.top_pairs(scores.wedge_scores(self.graph), self.params["by"], self.params["k"]).select("u", "v")


class Grouped(Selector):
    """params: k, groups (node, grp; by degree if missing), bailout, pairs."""

    def select(self) -> DataFrame:
        p = {"groups": None, "bailout": 0.5, "pairs": None} | self.params
        groups = grouped.degree_groups(self.graph) if p["groups"] is None else p["groups"]
        return grouped.select(self.graph, groups, p["k"], p["pairs"], p["bailout"])


class Nearest(Selector):
    """params: emb (id, vec), k, method (simple or descent), rounds, scorer, random_share (of the first lists of
    ``simple``; the rest are real neighbours). Scanned is what was scored, not what is emitted."""

    def select(self) -> DataFrame:
        p, self.scored = dict(self.params), []
        emb, name, share = p.pop("emb"), p.pop("method", "simple"), p.pop("random_share", 1.0)
        method = {"simple": knn.simple, "descent": knn.descent}[name]
        if name == "simple" and share < 1:
            p |= {"real": int(round(p["k"] * (1 - share), 9)), "edges": self.graph.adj}
        pairs = G.canonical(method(emb, scanned=self.scored, **p).select("u", "v"))
        return G.non_edges(pairs, self.graph.edges)

    def n_scanned(self) -> int:
        if self.found is None:
            self.run()
        return sum(self.scored)


class GroupSearch(Selector):
    """The whole grouped search behind one set of params.

    k; method: groups, forest, common, jaccard, adamic_adar or ensemble; embedding: factor1, factor2, two_sided,
    proximity (no vectors: Adamic-Adar pairs) or a table (id, vec); degree, structure and community: which groupings
    make the cells; groups (25 of one grouping, 25 degree bins of several) and groups_alt (5); bailout (0: none);
    tolerance: cells from that size on are searched by trees; epsilon (ensemble); dim; bipartite.
    """

    DEFAULTS = {
        "method": "groups", "embedding": "factor2", "degree": True, "structure": True, "community": True, "groups": None, "groups_alt": None,
        "bailout": 0.5, "tolerance": grouped.EXACT, "epsilon": 1.0, "dim": 128, "bipartite": False, "seed": 42,
    }

    def vectors(self, p: dict) -> DataFrame | None:
        kind = p["embedding"]
        if isinstance(kind, DataFrame):
            return kind
        if kind == "proximity":
            return None
        if kind in ("factor1", "factor2"):
            return cut(models.factor_embedding(self.graph, p["dim"], int(kind[-1])))
        if kind == "two_sided":
            counts = models.walk_counts(models.side_scaled(models.degree_centrality(self.graph)))
            return cut(models.skipgram_embedding(self.graph, models.walk_corpus(self.graph, counts, 4), dim=p["dim"])[0])
        raise ValueError(f"no embedding {kind}")

    def cells(self, p: dict, emb: DataFrame | None) -> DataFrame:
        flags = [x for x in ("degree", "structure", "community") if p[x]]
        if not flags:
            raise ValueError("at least one of degree, structure and community makes the groups")
        if p["community"] and emb is None:
            raise ValueError("community groups need vectors")
        several = len(flags) > 1
        first, alt = p["groups"] or 25, p["groups_alt"] or (5 if several else p["groups"] or 25)
        sizes = {x: (first if x == "degree" else alt) if p[x] else None for x in ("degree", "structure", "community")}
        return cut(grouped.mixed_groups(self.graph, emb, **sizes, sides=several and p["bipartite"]))

    def select(self) -> DataFrame:
        p = self.DEFAULTS | self.params
        k, method = p["k"], p["method"]
        scored = {"common": "common", "jaccard": "jaccard", "adamic_adar": "adamic_adar"}
        if method in scored:
            out = scores.wedge_scores(self.graph)
            out = out.where(G.cross_side(F.col("u"), F.col("v"))) if p["bipartite"] else out
            return scores.top_pairs(out, scored[method], k).select("u", "v")
        if method == "ensemble":
            return models.nmf_ensemble(self.graph, k, epsilon=p["epsilon"], seed=p["seed"]).select("u", "v")
        emb = self.vectors(p)
        if method == "forest":
            if emb is None:
                raise ValueError("a forest needs vectors")
            return lsh.forest_pairs(emb, k, dim=emb.select(F.size("vec")).first()[0], edges=self.graph.edges).select("u", "v")
        if method != "groups":
            raise ValueError(f"no method {method}")
        groups = self.cells(p, emb)
        pairs = None if emb is None else grouped.close_pairs(self.graph, groups, k, emb, p["tolerance"])
        if pairs is not None and p["bipartite"]:
            pairs = pairs.where(G.cross_side(F.col("u"), F.col("v")))
        return grouped.select(self.graph, groups, k, pairs, p["bailout"] or None)


class FactorEnsemble(Selector):
    """params: k, bags, share, rank, epsilon, mode, rho."""

    def select(self) -> DataFrame:
        return models.nmf_ensemble(self.graph, **self.params).select("u", "v")


def evaluate(selector: Selector, hidden: DataFrame, dataset: str, h: int) -> dict:
    """One run record: metrics, and the seconds that the selector took."""
    n, m = selector.graph.size()
    began = time.time()
    found = selector.run()
    took = time.time() - began
    row = metrics.benchmark_metrics(found, hidden, n).first()
    statistics = {"recall": row.recall, "precision": row.precision, "scan_rate": row.scan_rate, "scans_per_found_edge": row.scans_per_found_edge, "num_found_edges": row.n_found, "num_predicted_edges": row.n_predicted, "num_scanned_w_LP": selector.n_scanned(), "time": took}
    shown = {k: str(v) for k, v in selector.params.items() if not isinstance(v, DataFrame) and not callable(v)}
    return {"date": datetime.now(timezone.utc).isoformat(), "method": selector.name, "dataset": dataset, "h": h, "statistics": statistics, "parameters": {"h": str(h), "nodes": str(n), "edges": str(m), "hidden_edges": str(row.n_hidden)} | shown}


def multirun(spark: SparkSession, datasets: dict[str, DataFrame], selectors: dict[str, Callable[[G.Graph, int], Selector]], hs: Iterable[int] = range(1, 11), path: str | None = None, temporal: bool = True) -> tuple[DataFrame, list[str]]:
    """Run records of every selector, dataset (canonical edges) and h, and what failed. A selector that has
    scanned all pairs for one h is skipped for larger ones; a failure doesn't stop the others."""
    records, failures = [], []
    for dataset, edges in datasets.items():
        split = cut(splits.temporal_split(edges) if temporal else splits.static_split(edges))
        hidden = cut(split.where("part = 'test'").select("u", "v"))
        graph = G.Graph(cut(splits.train_graph(split)), cut(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()))
        n_hidden, full = hidden.count(), set()
        for h in hs:
            for name, make in selectors.items():
                if name in full:
                    continue
                try:
                    records.append(evaluate(make(graph, h * n_hidden), hidden, dataset, h) | {"method": name})
                except Exception as error:  # recorded, and the harness goes on
                    failures.append(f"{dataset}, {name}, h={h}: {error}")
                    continue
                if records[-1]["statistics"]["scan_rate"] >= 1:
                    full.add(name)
    out = spark.createDataFrame(records, files.RUN)
    if path:
        files.write_runs(out, path)
    return out, failures


#: The budget of a graph by the power of ten of its edges.
BUDGETS = ((100_000, 10_000), (1_000_000, 100_000), (10_000_000, 1_000_000), (None, 10_000_000))


def budget_for(edges: int) -> int:
    """How many pairs to select on a graph of so many edges."""
    return next(k for bound, k in BUDGETS if bound is None or edges < bound)


def experiment(spark: SparkSession, datasets: dict[str, DataFrame], methods: dict[str, dict], temporal: frozenset[str] = frozenset(), path: str | None = None) -> tuple[DataFrame, list[str]]:
    """Records of one grouped search a method (its params) and dataset, each with the budget of its size; datasets in
    ``temporal`` are split by time."""
    records, failures = None, []
    for name, edges in datasets.items():
        k = budget_for(edges.count())
        made = {m: (lambda g, _, p=params: GroupSearch(g, **({"k": k} | p))) for m, params in methods.items()}
        out, failed = multirun(spark, {name: edges}, made, (1,), path, name in temporal)
        records = out if records is None else records.unionByName(out)
        failures += failed
    return records, failures


def add_field(records: DataFrame, name: str, value: F.Column | str, inside: str | None = None) -> DataFrame:
    """Records with one more parameter (``inside='parameters'``), statistic or column."""
    value = F.lit(value) if not hasattr(value, "_jc") else value
    if inside == "parameters":
        return records.withColumn("parameters", F.map_concat(F.map_filter("parameters", lambda k, _: k != name), F.create_map(F.lit(name), value.cast("string"))))
    return records.withColumn(inside, F.col(inside).withField(name, value)) if inside else records.withColumn(name, value)


def without_parameters(records: DataFrame, *names: str) -> DataFrame:
    return records.withColumn("parameters", F.map_filter("parameters", lambda k, _: ~k.isin(*names)))


def flat_runs(records: DataFrame) -> DataFrame:
    """Records as the rows that the analytics read."""
    return records.select("dataset", "method", "h", "statistics.*", F.col("date").alias("seq"))
