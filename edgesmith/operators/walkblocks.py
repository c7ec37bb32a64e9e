"""Truncated personalised PageRank for graphs and states that no task holds.

Nodes are cut into blocks by ranges of their ids. A node's state, its best nodes in order, is kept once, with its neighbours, as
compressed rows. In a step each block gets the states of its neighbours, once for each block that has some, and makes its own new states
alone: no term of a sum is shuffled. Blocks are made so small that what one gets is held, and go in passes of a counted size, so
disk follows the states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgesmith.functions.lineage import forget, stored
from edgesmith.operators.wedges import _lists, _ranges, _spread

#: Entries of states that a block has, about, and that it gets at most while finer blocks help; those dealt in a pass; those of a row.
BLOCK, MOST, PASS, ROW = 1 << 21, 1 << 23, 1 << 27, 1 << 18
#: Most blocks, and by how much finer they are made at a time.
BLOCKS, FINER = 1 << 12, 2
#: Terms and sums of a task at once; above so many cells a term, sums go by a sort.
TERMS, CELLS, SPARSE = 1 << 18, 1 << 18, 4
#: Ranks go by p in so many parts; the code of a pair that is picked whatever its p, above all p.
PARTS, PICKED = 10**12, 1 << 41
#: Buckets that are counted at once in a search for the last pair.
BUCKETS = 1 << 12

STATE = "block long, part long, low long, high long, entries long, delta double, total double, blob binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Integers as narrow as their range, floats as they are, the bytes of a place together, compressed."""
    head, body = [len(arrays)], []
    for a in arrays:
        if a.dtype.kind == "f":
            low, width = 0, 0
            raw = a.astype("<f8", copy=False)
        else:
            low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
            width = next(w for w in (1, 2, 4, 8) if w == 8 or high - low < 1 << 8 * w)
            low = 0 if width == 8 else low
            raw = (a.astype(np.int64, copy=False) - low).astype(f"<i8" if width == 8 else f"<u{width}")
        head += [width, low, len(a)]
        body.append(np.ascontiguousarray(np.ascontiguousarray(raw).view(np.uint8).reshape(len(a), -1 if len(a) else width or 8).T).tobytes())
    return zstandard.ZstdCompressor(1).compress(np.array(head, "<i8").tobytes() + b"".join(body))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    many = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 3 * many, 8).reshape(many, 3).tolist(), 8 + 24 * many, []
    for width, low, n in head:
        size = width or 8
        flat = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T).reshape(-1)
        out.append(flat.view("<f8") if not width else flat.view("<i8") if width == 8 else flat.view(f"<u{width}").astype(np.int64) + low)
        at += size * n
    return out


def _begin(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def _reached(deg: np.ndarray, to: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a node, block) for each block in which a node has neighbours; neighbours ascend."""
    of, home = np.repeat(np.arange(len(deg)), deg), np.searchsorted(starts, to, "right")
    new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (home[1:] != home[:-1]))[: len(of)])
    return of[new], home[new]


def _rows(table: list[tuple], schema: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in table], t) for i, (_, t) in enumerate(schema)], [n for n, _ in schema])


_STATE = [("block", pa.int64()), ("part", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("entries", pa.int64()), ("delta", pa.float64()), ("total", pa.float64()), ("blob", pa.binary())]
_SENT = [("block", pa.int64()), ("part", pa.int64()), ("own", pa.int64()), ("blob", pa.binary())]
_PAIRS = [("block", pa.int64()), ("blob", pa.binary())]


def _columns(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and each one's place."""
    low, high = int(v.min()), int(v.max())
    if high - low >= 16 * len(v):
        return np.unique(v, return_inverse=True)
    met = np.zeros(high - low + 1, bool)
    met[v - low] = True
    place = np.cumsum(met, dtype=np.int32) - 1
    return np.flatnonzero(met) + low, place[v - low].astype(np.int64)


class Walk:
    """Blocks of a graph and the states of their nodes."""

    def __init__(self, edges: DataFrame, budget: int | None, damping: float, keep: float, n: int | None):
        self.spark, self.damping, self.keep = edges.sparkSession, damping, keep
        whole = edges.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
        kept, path = stored(whole)
        most, self.budget = kept.count(), budget  # repeated edges are dropped later
        cores = self.spark.sparkContext.defaultParallelism
        count = max(1, -(-int((most if budget is None else budget) * keep) // BLOCK), min(cores, 2 * most >> 14))
        fine = min(BLOCKS, count * FINER**6, max(1, 2 * most))
        cuts = kept.select(F.explode(F.array("u", "v")).alias("x")).agg(F.percentile_approx("x", [i / fine for i in range(1, fine)], 20_000)).first()[0] if fine > 1 else []
        cuts = np.array(cuts or [], np.int64)
        levels, step = [], max(1, fine // count)
        while True:
            levels.append(np.unique(cuts[step - 1 :: step]))
            if step == 1:
                break
            step = max(1, step // FINER)
        lists, lists_path = stored(_lists(kept, levels[0]))
        forget(self.spark, path)
        self._size(lists, levels, n)
        self.state, self.path = stored(lists.mapInArrow(self._first(), STATE))
        forget(self.spark, lists_path)

    def _size(self, lists: DataFrame, levels: list[np.ndarray], n: int | None) -> None:
        """The budget, the share of a node, and blocks by what they get at most."""

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column("blob").to_pylist():
                    nodes, deg, to = _spread(blob)
                    out = [(-1, 0, len(nodes), 0), (-1, 1, len(to), 0)]
                    for i, starts in enumerate(levels):
                        of, home = _reached(deg, to, starts)
                        got, lists = np.bincount(home, deg[of], len(starts) + 1), np.bincount(home, minlength=len(starts) + 1)
                        out += [(i, j, int(got[j]), int(lists[j])) for j in np.flatnonzero(got).tolist()]
                    yield _rows(out, [("level", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("lists", pa.int64())])

        told = lists.mapInArrow(sizes, "level long, block long, n long, lists long").groupBy("level", "block").agg(F.sum("n").alias("n"), F.sum("lists").alias("lists")).collect()
        own = {r["block"]: r["n"] for r in told if r["level"] < 0}
        n, m = n or own.get(0, 0), own.get(1, 0) // 2
        self.budget = m if self.budget is None else self.budget
        self.entries, self.most = n, self.budget * self.keep + n
        self.share = (self.budget / n) / ((2 * m) / n) if m else 0.0
        for i, starts in enumerate(levels):
            # rounding up may add one to each state
            self.starts, self.gets = starts, {r["block"]: int(r["n"] * self.share * self.keep) + r["lists"] for r in told if r["level"] == i}
            if max(self.gets.values(), default=0) <= MOST:
                break

    def _first(self):
        starts = self.starts

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob, part in zip(batch.column("blob").to_pylist(), batch.column("part").to_pylist(), strict=True):
                    nodes, deg, to = _spread(blob)
                    cuts = np.concatenate([[0], np.searchsorted(nodes, starts), [len(nodes)]])
                    end = np.append(0, np.cumsum(deg))
                    for b in np.flatnonzero(np.diff(cuts)).tolist():
                        lo, hi = cuts[b], cuts[b + 1]
                        yield _rows([_state_row(b, part, starts, nodes[lo:hi], deg[lo:hi], to[end[lo] : end[hi]], np.ones(hi - lo, np.int64), nodes[lo:hi], np.ones(hi - lo))], _STATE)

        return first

    def step(self, track: bool) -> tuple[float, float]:
        """One iteration; delta and total of the stopping rule, if they are asked for."""
        passes, room = [], 0
        for block, n in sorted(self.gets.items()):
            n *= min(1, self.entries / self.most)  # early states are short
            if not passes or n > room:
                passes.append([block, block + 1, 0])
                room = PASS
            passes[-1][1:] = block + 1, passes[-1][2] + 1
            room -= n
        new, paths = None, []
        for lo, hi, tasks in passes:
            sent = self.state.where((F.col("low") < hi) & (F.col("high") >= lo)).select("block", "part", "blob").mapInArrow(_dealer(self.starts, lo, hi), "block long, part long, own long, blob binary")
            solve = _solver(self.starts, self.damping, self.share, self.keep, track)
            part, path = stored(sent.repartition(4 * tasks, "block").groupBy("block").applyInArrow(solve, STATE))
            new = part if new is None else new.unionByName(part)
            paths.append(path)
        self.forget()
        self.state, self.path = new, paths
        self.entries, delta, total = new.agg(F.sum("entries"), F.sum("delta"), F.sum("total")).first()
        return delta, total

    def forget(self) -> None:
        for path in [self.path] if isinstance(self.path, str) else self.path:
            forget(self.spark, path)

    def candidates(self, bipartite: bool) -> DataFrame:
        """(u, v): each source's first floor(k) eligible nodes, then the best of the next ceil(k) until the budget is reached."""
        starts = self.starts
        told = self.state.select("blob").mapInArrow(_emitter(starts, self.share, bipartite), "block long, blob binary")
        pairs = stored(told.repartition(4 * (len(starts) + 1), "block").groupBy("block").applyInArrow(_pairs, "u long, v long, code long"))[0]
        self.forget()
        picks = F.col("code") == PICKED
        taken, n = pairs.agg(F.count_if(picks), F.count(F.lit(1))).first()
        more = max(0, self.budget - taken)
        if more < n - taken:
            pairs = pairs.where(picks | (earliest(pairs.where(~picks).withColumn("x", PICKED - F.col("code")), {"x": PICKED - F.col("code"), "u": F.col("u"), "v": F.col("v")}, more) if more else F.lit(False)))
        return pairs.select("u", "v")


def _state_row(block: int, part: int, starts: np.ndarray, nodes, deg, to, size, v, p, delta: float = 0.0, total: float = 0.0) -> tuple:
    low, high = np.searchsorted(starts, [to.min(), to.max()], "right").tolist() if len(to) else (block, block)
    return block, part, min(low, block), max(high, block), len(v), delta, total, _pack(nodes, deg, to, size, v, p)


def _dealer(starts: np.ndarray, lo: int, hi: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "blob")), strict=True):
                if lo <= block < hi:
                    yield _rows([(block, part, 1, blob)], _SENT)
                nodes, deg, to, size, v, p = _unpack(blob)
                of, home = _reached(deg, to, starts)
                some = (home >= lo) & (home < hi) & (home != block)
                of, home = of[some], home[some]
                order = np.argsort(home, kind="stable")
                of, home = of[order], home[order]
                begin = _begin(size)
                for j in np.unique(home).tolist():
                    mine = of[slice(*np.searchsorted(home, [j, j + 1]))]
                    at = _ranges(begin[mine], size[mine])
                    yield _rows([(j, part, 0, _pack(nodes[mine], size[mine], v[at], p[at]))], _SENT)

    return deal


def _solver(starts: np.ndarray, damping: float, share: float, keep: float, track: bool):
    def solve(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        rows = rows.sort_by([("part", "ascending")])  # sums in one order
        told = zip(rows.column("own").to_pylist(), rows.column("blob"), strict=True)
        own, got = [], []
        for mine, blob in told:
            x = _unpack(blob.as_py())
            if mine:
                own.append(x[:4])
                x = [x[0], x[3], x[4], x[5]]
            got.append(x)
        nodes, deg, to, _ = (np.concatenate(c) for c in zip(*own, strict=True))
        near, size, v, p = (np.concatenate(c) for c in zip(*got, strict=True))
        del got, own, x
        vs, col = _columns(np.concatenate([v, nodes]))
        col, home = col[: len(v)], col[len(v) :]
        del v
        begin = _begin(size)
        order = np.argsort(near)
        at = order[np.searchsorted(near, to, sorter=order)]  # every neighbour's state was sent
        mine = order[np.searchsorted(near, nodes, sorter=order)]
        trunc = np.ceil(deg * share * keep).astype(np.int64)
        row = np.repeat(np.arange(len(nodes)), deg)
        take = np.minimum(trunc[row], size[at])
        edge = np.append(0, np.cumsum(deg))
        met = np.append(0, np.cumsum(take))[edge] + np.arange(len(nodes) + 1)
        n, out, held, entries, lo = len(vs), [], [], 0, 0
        dense = len(nodes) * n <= SPARSE * int(met[-1])
        while lo < len(nodes):
            hi = int(np.searchsorted(met, met[lo] + TERMS, "right")) - 1
            hi = max(lo + 1, min(hi, lo + CELLS // n) if dense else hi)
            some = slice(edge[lo], edge[hi])
            from_ = _ranges(begin[at[some]], take[some])
            key = np.append(np.repeat((row[some] - lo) * n, take[some]) + col[from_], np.arange(hi - lo) * n + home[lo:hi])
            term = np.append(np.repeat((damping / deg[row[some]]), take[some]) * p[from_], np.full(hi - lo, 1 - damping))
            if dense:
                term = np.bincount(key, term)
                key = np.flatnonzero(term)
                term = term[key]
            else:
                order = np.argsort(key)
                key = key[order]
                new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                key, term = key[new], np.add.reduceat(term[order], new)
            key, term, count = _best(key, term, n, trunc[lo:hi])
            delta, total = _change(key, term, n, _old(mine[lo:hi], begin, size, col, p, n)) if track else (0.0, 0.0)
            held.append((slice(lo, hi), count, vs[key % n], term, delta, total))
            entries += len(key)
            lo = hi
            if entries >= ROW or lo == len(nodes):
                a, b = held[0][0].start, lo
                size_, v_, p_ = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
                out.append(_state_row(block, (block << 32) + a, starts, nodes[a:b], deg[a:b], to[edge[a] : edge[b]], size_, v_, p_, sum(h[4] for h in held), sum(h[5] for h in held)))
                held, entries = [], 0
        return pa.Table.from_batches([_rows(out, _STATE)])

    return solve


def _best(key: np.ndarray, p: np.ndarray, n: int, trunc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys row * n + column, ascending, the first trunc of each row by p, ties to the smaller; and how many each row has."""
    row = key // n
    code = (row << 41) + (PICKED - 1 - np.floor(p * PARTS + 0.5).astype(np.int64))
    begin = np.searchsorted(key, np.arange(len(trunc)) * n)
    count = np.diff(np.append(begin, len(key)))
    if (count > trunc).any():
        bar = np.sort(code)[begin + np.minimum(count, trunc) - 1]  # every row has itself
        live = code <= bar[row]
        key, p, row, code = key[live], p[live], row[live], code[live]
    order = np.argsort(code, kind="stable")
    key, p, row = key[order], p[order], row[order]
    first = np.searchsorted(row, np.arange(len(trunc)))
    live = np.arange(len(row)) - first[row] < trunc[row]
    return key[live], p[live], np.bincount(row[live], minlength=len(trunc))


def _old(mine: np.ndarray, begin: np.ndarray, size: np.ndarray, col: np.ndarray, p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = _ranges(begin[mine], size[mine])
    return np.repeat(np.arange(len(mine)) * n, size[mine]) + col[at], p[at]


def _change(key: np.ndarray, p: np.ndarray, n: int, old: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Delta and total; an entry on both sides counts twice in both."""
    order = np.argsort(key)
    key, p = key[order], p[order]
    at = np.minimum(np.searchsorted(key, old[0]), len(key) - 1)
    both = key[at] == old[0]
    a, b = old[1][both], p[at[both]]
    gone = float(old[1][~both].sum())
    return float(2 * np.abs(a - b).sum()) + gone + float(p.sum() - b.sum()), float(2 * a.sum()) + gone


def _emitter(starts: np.ndarray, share: float, bipartite: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                nodes, deg, to, size, v, p = _unpack(blob)
                vs, col = _columns(np.concatenate([to, v]))
                n, row = len(vs), np.repeat(np.arange(len(nodes)), size)
                known = np.repeat(np.arange(len(nodes)) * n, deg) + col[: len(to)]  # ascending
                key = row * n + col[len(to) :]
                free = (v != nodes[row]) & (known[np.minimum(np.searchsorted(known, key), len(known) - 1)] != key)
                if bipartite:
                    free &= v % 2 != nodes[row] % 2
                row, v, p = row[free], v[free], p[free]
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                k = deg * share
                pick, pool = np.floor(k)[row], np.ceil(k)[row]
                code = np.where(rank <= pick, PICKED, np.floor(p * PARTS + 0.5).astype(np.int64))
                live = rank <= pick + pool
                q, v, code = nodes[row][live], v[live], code[live]
                u, v = np.minimum(q, v), np.maximum(q, v)
                order = np.lexsort((v, u))
                u, v, code = u[order], v[order], code[order]
                cuts = np.concatenate([[0], np.searchsorted(u, starts), [len(u)]])
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    some = slice(cuts[b], cuts[b + 1])
                    yield _rows([(b, _pack(u[some], v[some], code[some]))], _PAIRS)

    return emit


def _pairs(rows: pa.Table) -> pa.Table:
    """Distinct pairs and the largest code of each."""
    u, v, code = (np.concatenate(c) for c in zip(*(_unpack(b.as_py()) for b in rows.column("blob")), strict=True))
    order = np.lexsort((-code, v, u))
    u, v, code = u[order], v[order], code[order]
    new = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))
    return pa.table([u[new], v[new], code[new]], ["u", "v", "code"])


def earliest(rows: DataFrame, keys: dict[str, Column], n: int) -> Column:
    """What holds for the first n rows by integer keys in their order; names are those of ``rows``, columns those of the result's
    table. Counts of buckets reach the driver, so no row is sorted."""
    before, same = F.lit(False), F.lit(True)
    for name, column in keys.items():
        low, high = rows.agg(F.min(name), F.max(name)).first()
        while True:
            width = (high - low) // BUCKETS + 1
            inside = rows.where(F.col(name).between(low, high)).groupBy(F.expr(f"({name} - {low}L) div {width}L").alias("b")).count()
            for b, count in sorted(tuple(r) for r in inside.collect()):
                if n <= count:
                    break
                n -= count
            low, high = low + b * width, min(high, low + (b + 1) * width - 1)
            if n == count:
                return before | (same & (column <= high))
            if width == 1:
                break
        before, same, rows = before | (same & (column < low)), same & (column == low), rows.where(F.col(name) == low)
    return before | same


def walk(edges: DataFrame, budget: int | None = None, damping: float = 0.8, epsilon: float = 0.05, keep: float = 20, max_iterations: int = 9, min_iterations: int = 3, bipartite: bool = False, iterations: int | None = None, nodes: int | None = None) -> tuple[DataFrame, list[float]]:
    """Candidates (u, v) and the ratio of each iteration, as ``walkrank.TruncatedPageRank`` has them: of distinct edges between integers,
    with a ``budget`` (one pair an edge, if none is given), over ``nodes`` nodes if some have no edge. After so many ``iterations``,
    if given, without ratios."""
    w = Walk(edges, budget, damping, keep, nodes)
    if not w.gets or w.budget <= 0:
        w.forget()
        return edges.sparkSession.createDataFrame([], "u long, v long"), []
    ratios: list[float] = []
    for i in range(max_iterations if iterations is None else iterations):
        delta, total = w.step(iterations is None)
        if iterations is None:
            ratios.append(delta / total if total else 0.0)
            if i + 1 >= min_iterations and ratios[-1] < epsilon:
                break
    return w.candidates(bipartite), ratios
