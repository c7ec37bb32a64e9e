"""Each stage against a plain version on its own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from edgesmith.llm import op4_tokens as op4
from edgesmith.llm.common import materialise

from . import fixtures as X


def test_stages(spark, tmp_path):
    docs = X.documents(spark, X.texts(160, 12)).withColumns({"id": F.lit("mine"), "a.b": F.lit(1), "row": F.lit("r"), "size": F.lit(2), "words": F.lit(3), "key": F.lit(4)})
    names = docs.columns
    before = docs.collect()
    kept = materialise(P.quality(spark, docs, ""))
    assert kept.columns == names
    rows = kept.collect()
    assert {r.doc_id for r in rows} < {r.doc_id for r in before} and all(len(X.words(r.text)) >= 50 for r in rows)
    one = materialise(P.near_duplicate(spark, kept, ""))
    assert one.columns == names
    groups = X.components([(r.doc_id, r.text) for r in rows])
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in groups.values()})
    cut = materialise(P.passages(spark, one, ""))
    assert cut.columns == names
    want = X.passages([(r.doc_id, r.text) for r in one.collect()])
    assert {r.doc_id: (r.text, r.n_chars, r.id) for r in cut.collect()} == {i: ((t := w[4].decode(errors="ignore")), len(t), "mine") for i, w in want.items()}
    mixed = materialise(P.mixture(spark, cut, ""))
    assert mixed.columns == names
    total, size = {}, {r.doc_id: len(X.words(r.text)) for r in cut.collect()}
    for r in mixed.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + len(X.words(r.text))
        assert r.n_chars == len(r.text)
    assert all(n <= 3 * size[i] for i, n in total.items())
    assert sum(total.values()) == pytest.approx(sum(size.values()), abs=len({r.source for r in cut.collect()}))
    packed = P.packing(spark, mixed, "").collect()
    assert sorted(r.doc_id for r in packed) == sorted(r.doc_id for r in mixed.collect())
    trie = op4.Trie(op4.vocabulary())
    assert all(r.length == sum(trie.tokens(w) for w in X.words(r.text)) <= r.bucket_length for r in packed)
    assert mixed.select("`a.b`", "row", "size", "words", "key").distinct().collect() == [(1, "r", 2, 3, 4)]


def test_repeated_rows_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, long, "en", "a", 1), (1, long, "en", "a", 1), (None, long + " x", "en", None, 1), (2, None, None, None, None)], X.DOCS)
    out = docs
    for _, stage in P.STAGES:
        out = materialise(stage(spark, out, ""))
    assert [r.doc_id for r in out.collect()].count(2) == 0 and out.count() >= 1
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = materialise(stage(spark, empty, ""))
    assert empty.count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the shared tables are not here")
def test_run(spark):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0
