import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edgesmith.llm import components, kernels, op1_fingerprints as op1, op2_suffix_dedup as op2, op10_jaccard_join as op10

from . import fixtures as X
from .test_others import against_sql


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("pack_bytes", [2_000, 1 << 22])
def test_passages_match_brute_force(spark, pack_bytes):
    docs = X.documents(spark)
    want = X.passages(pairs_of(docs))
    got = op2.removed_passages(docs, pack_bytes=pack_bytes).collect()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {i: w[:4] for i, w in want.items()}
    for r in got:
        assert r.kept_text == want[r.id][4].decode(errors="ignore")
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert sum(r.n_removed for r in got) > 5_000


def test_passages_of_other_lengths(spark):
    docs = X.documents(spark, X.texts(40, 9))
    want = X.passages(pairs_of(docs), 20)
    got = op2.removed_passages(docs, threshold=20, gram=8, pack_bytes=3_000, with_text=False).collect()
    assert {r.id: r.n_removed for r in got} == {i: w[1] for i, w in want.items()}


@pytest.mark.parametrize("crowd", [0, 3])
def test_crowds_are_dealt_by_their_windows(spark, crowd):
    """A line of fewer bytes than a passage in every text, in other surroundings each, beside passages and repeats."""
    r = np.random.default_rng(4)
    noise = lambda k: "".join(map(chr, r.integers(97, 123, k)))
    line = "-" * 30 + " a line that all have"
    rows = [noise(40) + line[: 49 - i % 3] + noise(30) for i in range(40)] + [f"{noise(9)} {line} {noise(9)}" * 2 for _ in range(6)] + X.texts(40, 11)
    docs = X.documents(spark, rows)
    want = X.passages(pairs_of(docs))
    got = op2.removed_passages(docs, pack_bytes=1_500, crowd=crowd).collect()
    assert {i.id: (i.n_bytes, i.n_removed, i.n_spans, i.kept_sha256) for i in got} == {i: w[:4] for i, w in want.items()}


def test_passages_match_sql(spark, tmp_path):
    against_sql(spark, tmp_path, op2.SQL, op2.op2_suffix_dedup, "documents", X.documents(spark, X.texts(100, 15)))


def test_passages_edge_cases(spark):
    t = "abcdefghij" * 6
    docs = spark.createDataFrame([(1, t, "x"), (1, t, "y"), (None, t, "z"), (2, None, "n"), (3, "", "e"), (4, t + "é", "c")], "doc_id long, text string, bucket string").withColumn("g", F.lit(5)).withColumn("id", F.lit(6))
    got = {r.carry.bucket: r for r in op2.removed_passages(docs).collect()}
    assert [got[k].n_removed for k in "xyznec"] == [0, 0, 60, 0, 0, 60]
    assert (got["c"].kept_text, got["c"].carry.g, got["c"].carry.id) == ("é", 5, 6)
    assert op2.removed_passages(docs.limit(0)).count() == 0


def test_query_columns(spark, tmp_path):
    X.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert op2.op2_suffix_dedup(spark, str(tmp_path)).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert op10.op10_jaccard_join(spark, str(tmp_path)).columns == ["doc_id", "n_shingles", "component_id"]


@pytest.mark.parametrize(("pack_bytes", "tile_nodes"), [(2_000, 1024), (1 << 22, 2)])
def test_components_match_brute_force(spark, pack_bytes, tile_nodes):
    docs = X.documents(spark, X.texts(96, 4))
    want = X.components(pairs_of(docs))
    got = op10.near_duplicates(docs, pack_bytes=pack_bytes, tile_nodes=tile_nodes).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_large_groups_in_many_tiles(spark):
    """A chain: each text is near the next only, so hubs alone can't tie it together."""
    words = [f"w{i}" for i in range(400)]
    rows = [" ".join(words[k * 4 : k * 4 + 60]) for k in range(70)] + ["other " + " ".join(words[100:160])]
    docs = X.documents(spark, rows)
    want = X.components(pairs_of(docs))
    got = op10.near_duplicates(docs, tile_nodes=8).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) == 1


def test_chains_of_shared_passages_make_no_group(spark):
    """Each text shares one passage with the next and is no near copy: many trees of two, none of all."""
    r = np.random.default_rng(7)
    passages = [" ".join(f"p{k}x{r.integers(1 << 20)}" for _ in range(16)) for k in range(61)]
    rows = [f"{passages[k]} " + " ".join(f"own{k}x{i}" for i in range(10)) + f" {passages[k + 1]}" for k in range(60)]
    rows += [rows[5] + " end", rows[40].upper()]
    docs = X.documents(spark, rows)
    for tile_nodes in (2, 1024):
        got = {r.id: (r.n_shingles, r.component_id) for r in op10.near_duplicates(docs, tile_nodes=tile_nodes).collect()}
        assert got == X.components(pairs_of(docs))
        assert len({c for _, c in got.values()}) == 60


def test_words_of_two_letters_do_not_collide(spark):
    """Complements of one another in letters, which every polynomial modulo a power of two takes for one."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = X.documents(spark, [word, other, f"{word} x y z v w", f"{other} x y z v w", f"{word} x y z v w"])
    assert {r.id: (r.n_shingles, r.component_id) for r in op10.near_duplicates(docs).collect()} == X.components(pairs_of(docs))


def test_components_match_sql(spark, tmp_path):
    against_sql(spark, tmp_path, op10.SQL, op10.op10_jaccard_join, "documents", X.documents(spark, X.texts(120, 14)))


def test_components_edge_cases(spark):
    docs = spark.createDataFrame([(5, "a b"), (4, "A  b"), (4, "A  b"), (None, "a\tB"), (7, None), (8, " "), (9, "a b c")], "doc_id long, text string").withColumn("node", F.lit(1))
    got = sorted(((r.id or 0, r.n_shingles, r.component_id) for r in op10.near_duplicates(docs).collect()))
    assert got == [(0, 1, 4), (4, 1, 4), (4, 1, 4), (5, 1, 4), (7, 0, 7), (8, 0, 8), (9, 1, 9)]
    assert op10.near_duplicates(docs.limit(0)).count() == 0


def test_tree_finds_every_component():
    r = np.random.default_rng(2)
    base = np.unique(r.integers(0, 1 << 63, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[r.random(len(base)) < 0.93], r.integers(0, 1 << 63, r.integers(1, 20), dtype=np.uint64)])) for _ in range(60)]
    sets += [np.unique(r.integers(0, 1 << 63, 250, dtype=np.uint64)) for _ in range(60)]
    links = op10.tree_links(sets, np.arange(len(sets)))
    forest = op10.Forest(np.arange(len(sets)))
    for a, b in links:
        forest.join(a, b)
    want = op10.Forest(np.arange(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                want.join(i, j)
    assert [forest.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]
    parts = np.arange(len(sets)) % 2
    assert all(parts[a] != parts[b] for a, b in op10.tree_links(sets, np.arange(len(sets)), parts))


def test_shingle_sets_match_words():
    rows = X.texts(80, 6)
    got = list(kernels.shingle_sets(pa.array(rows, pa.string())))
    assert [len(s) for s in got] == [len(X.shingles(t)) for t in rows]
    again = list(kernels.shingle_sets(pa.array(rows, pa.large_string()).slice(3, 20)))
    assert all((a == b).all() for a, b in zip(again, got[3:23], strict=True))


def test_fingerprints_match_brute_force(spark):
    docs = X.documents(spark)
    rows = sorted((i, t or "") for i, t in pairs_of(docs))
    got = {r.doc_id: r for r in op1.edited_likeness(docs, k=1 << 16).collect()}
    jac = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].near_edited == pytest.approx(jac(X.shingles(t), X.shingles(edited)))
        assert got[i].near_next == pytest.approx(jac(X.shingles(t), X.shingles(after)))
        assert got[i].n_shingles_estimate == len(X.shingles(t))


def test_query_keeps_the_smallest_hashes(spark, tmp_path):
    """The registered query, with its own size: sketches and likeness from each shingle hashed on its own."""
    docs = X.documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted((i, t or "") for i, t in pairs_of(docs))
    k, memo = op1.K, {}

    def sketch(text):
        mine = X.shingles(text)
        for s in mine - set(memo):
            memo[s] = int(next(iter(kernels.shingle_sets(pa.array([" ".join(s)]))))[0])
        return sorted(memo[s] for s in mine)[:k]

    def like(a, b):
        union = sorted({*a, *b})[:k]
        return len({*a} & {*b} & {*union}) / len(union) if union else 1.0

    got = {r.doc_id: r for r in op1.op1_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and any(len(X.shingles(t)) > k for _, t in rows)
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        q = len(t) // 4
        a, e, b = sketch(t), sketch(t[: len(t) - q] + after[:q]), sketch(after)
        assert op1.decode(got[i].fingerprint).tolist() == a and op1.decode(got[i].edited_fingerprint).tolist() == e
        assert got[i].near_edited == pytest.approx(like(a, e)) and got[i].near_next == pytest.approx(like(a, b))


def test_sketches_merge_and_estimate():
    long = " ".join(f"w{i}" for i in range(6000))
    part = " ".join(f"w{i}" for i in range(3000))
    whole, half = op1.sketches(pa.array([long, part]), 512)
    assert op1.distinct(whole, 512) == pytest.approx(5996, rel=0.15)
    assert op1.resemblance(whole, half, 512) == pytest.approx(0.5, abs=0.08)
    assert op1.containment(half, whole, 512) == pytest.approx(1.0, abs=0.15)
    two = list(op1.sketches(pa.array([part, " ".join(f"w{i}" for i in range(2996, 6000))]), 512))
    assert (op1.merge(*two, 512) == whole).all()
    assert (op1.decode(op1.encode(whole)) == whole).all()


def test_fingerprints_edge_cases(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b d"), (2, "q r s t u v"), (2, None), (9, "")], "doc_id long, text string").withColumn("pid", F.lit(1))
    got = op1.edited_likeness(docs).collect()
    assert len(got) == 5 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = op1.edited_likeness(docs.where("doc_id = 9")).collect()
    assert [(r.near_edited, r.near_next, r.edited_sha256) for r in one] == [(1.0, 1.0, hashlib.sha256(b"").hexdigest())]
    assert op1.edited_likeness(docs.limit(0)).count() == 0
    f = op1.fingerprints(docs.withColumn("fingerprint", F.lit("mine"))).collect()
    assert {r.row.fingerprint for r in f} == {"mine"} and len({r.fingerprint for r in f}) == 4


def test_few_links_take_no_rounds(spark, monkeypatch):
    """The driver joins few links as the rounds do, and writes the links and the labels only."""
    r = np.random.default_rng(6)
    rows = [*r.integers(0, 300, (150, 2)).tolist(), *([i, i + 1] for i in range(400, 480)), [900, 900], [7, 5], [5, 7]]
    links = spark.createDataFrame(rows, "a long, b long")
    up = {}
    for a, b in rows:
        if a != b:
            x, y = up.setdefault(a, {a}), up.setdefault(b, {b})
            if x is not y:
                x |= y
                up |= dict.fromkeys(y, x)
    want = {i: min(of) for i, of in up.items()}
    written = []
    monkeypatch.setattr(components, "materialise", lambda *a, f=components.materialise: written.append(1) or f(*a))
    for held, most in ((components.HELD, 2), (0, 99), (100, 99)):
        written.clear()
        got = components.components(links, held=held).collect()
        assert len(got) == len(want) and {r.node: r.label for r in got} == want
        assert len(written) <= most
    assert components.components(links.limit(0)).count() == 0
