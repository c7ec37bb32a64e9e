"""The selectors' interface, the benchmark loop and the command line."""

import pytest

from edgesmith import __main__ as cli
from edgesmith.operators import graph as G
from edgesmith.operators import metrics
from edgesmith.plans import harness as H
from edgesmith.sources import files


@pytest.fixture(scope="module")
def edges(spark):
    rows = sorted({tuple(sorted((i, (i * k + k) % 24))) for i in range(24) for k in (1, 3, 5) if i != (i * k + k) % 24})
    return spark.createDataFrame([(u, v, i) for i, (u, v) in enumerate(rows)], "u long, v long, ts long").cache()


def test_every_selector_emits_canonical_non_edges(spark, edges):
    g = G.Graph(edges.select("u", "v"))
    emb = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(24)], "id long, vec array<double>")
    known = {(r.u, r.v) for r in edges.collect()}
    made = [H.TruncatedWalk(g, budget=10), H.BreadthFirst(g, k=4, exclude_edges=True), H.RestartWalk(g, k=2, steps=10), H.PersonalPageRank(g, k=2, iterations=4), H.Neighbourhood(g, by="jaccard", k=5), H.Grouped(g, k=10), H.Nearest(g, emb=emb, k=2, rounds=2), H.Nearest(g, emb=emb, k=2, rounds=2, method="descent"), H.FactorEnsemble(g, k=5, bags=2, share=0.5, epsilon=0.01)]
    for s in made:
        got = [(r.u, r.v) for r in s.run().collect()]
        scanned = s.n_scanned() >= len(got) if isinstance(s, H.Nearest) else s.n_scanned() == len(got)
        assert scanned and len(got) == len(set(got)) and all(u < v for u, v in got) and not set(got) & known, s.name
    assert made[0].n_scanned() <= 10 and made[4].n_scanned() == 5


def test_multirun_records_and_goes_on_after_failures(spark, edges, tmp_path):
    selectors = {"aa": lambda g, k: H.Neighbourhood(g, by="adamic_adar", k=k), "bad": lambda g, k: H.Neighbourhood(g, by="nothing", k=k)}
    out, failures = H.multirun(spark, {"toy": edges}, selectors, (1, 2), str(tmp_path / "runs"))
    assert len(failures) == 2 and "bad" in failures[0]
    back = files.runs(spark, str(tmp_path / "runs"))
    assert {(r.method, r.h) for r in back.collect()} == {("aa", 1), ("aa", 2)}
    assert metrics.average_recall(H.flat_runs(back)).count() == 1
    more = H.add_field(H.add_field(back, "seed", 42, "parameters"), "note", "x").first()
    assert more.parameters["seed"] == "42" and more.note == "x" and more.parameters["hidden_edges"]
    assert "h" not in H.without_parameters(back, "h").first().parameters


def test_command_line(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# edges\n" + "\n".join(f"n{a} n{b}" for a, b in [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (4, 5), (5, 6)]))
    cli.main([str(tmp_path / "e.txt"), str(tmp_path / "out"), "--budget", "4", "--keep", "20"])
    got = {tuple(sorted(map(str, r))) for r in spark.read.csv(str(tmp_path / "out")).collect()}
    assert got == {("n1", "n4"), ("n2", "n5"), ("n3", "n5"), ("n4", "n6")}
