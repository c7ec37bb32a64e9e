"""All pairs of a table of vectors, scored strip by strip in Arrow tasks that hold the whole table.

Sums run over the entries in order and rounding is half away from zero, so scores are those that SQL gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most numbers (8 bytes each) of the vectors that every task holds; larger tables go by joins.
HELD = 1 << 24
#: Rows and columns of what is scored at once.
STRIP, TILE = 128, 1024
#: Pairs that a task scores, about.
TASK = 1 << 24


class Vectors:
    """ids ascending, their vectors, and ``more`` (a long column, null where ``known`` is false)."""

    def __init__(self, rows: pa.Table, width: int):
        ids = rows.column("id").to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        flat = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in rows.column("vec").chunks]
        self.ids = ids[order]
        self.matrix = (np.concatenate(flat) if flat else np.zeros(0)).reshape(len(ids), width)[order]
        more = rows.column("more").combine_chunks()
        self.known = np.asarray(more.is_valid().to_numpy(zero_copy_only=False), bool)[order]
        self.more = more.fill_null(0).to_numpy(zero_copy_only=False)[order]

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Positions of ids, -1 for those that aren't there."""
        at = np.minimum(np.searchsorted(self.ids, ids), max(len(self.ids) - 1, 0))
        return np.where(self.ids[at] == ids, at, -1) if len(self.ids) else np.full(len(ids), -1)


def hold(emb: DataFrame, more: str | None = None, most: int = HELD) -> Vectors | None:
    """The vectors (id, vec) and a column, or None if they are more than ``most`` numbers, counted, or not all of one length and
    finite, or an id is missing, repeated or no integer."""
    if not isinstance(emb.schema["id"].dataType, T.IntegralType):
        return None
    odd = F.col("id").isNull() | F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    n, low, high, bad = emb.agg(F.count(F.lit(1)), F.min(F.size("vec")), F.max(F.size("vec")), F.count_if(odd)).first()
    if n and (bad or low != high or low < 1 or n * high > most):
        return None
    rows = emb.select(F.col("id").cast("long"), F.col("vec").cast("array<double>"), (F.col(more) if more else F.lit(None)).cast("long").alias("more"))
    made = Vectors(rows.toArrow(), high or 0)
    return made if len(np.unique(made.ids)) == n else None


def rounded(x: np.ndarray, digits: int = 9) -> np.ndarray:
    scaled = x * 10.0**digits
    whole = np.trunc(scaled)
    return (whole + np.sign(scaled) * (np.abs(scaled - whole) >= 0.5)) / 10.0**digits + 0.0


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The products of all rows of x and all rows of y, each summed entry by entry."""
    out, term = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
        np.multiply(a[:, None], b, out=term)
        out += term
    return out


def rounded_dots(x: np.ndarray, y: np.ndarray, one_less: bool = False) -> np.ndarray:
    """``rounded(dots(x, y))``, or of one less these, by a matrix product; sums so near a rounding edge that their order decides
    are made again entry by entry."""
    near = x @ y.T
    if one_less:
        np.subtract(1, near, out=near)
    most = np.sqrt((x * x).sum(1).max(initial=0) * (y * y).sum(1).max(initial=0)) + one_less
    doubt = 4 * (x.shape[1] + 2) * np.finfo(float).eps * most * 1e9
    scaled = near * 1e9
    np.abs(scaled, out=scaled)
    scaled -= np.floor(scaled)
    scaled -= 0.5
    i, j = np.nonzero(~(np.abs(scaled, out=scaled) > doubt))
    for lo in range(0, len(i), TILE * STRIP):
        a, b = i[lo : lo + TILE * STRIP], j[lo : lo + TILE * STRIP]
        again = np.zeros(len(a))
        for c in range(x.shape[1]):
            again += x[a, c] * y[b, c]
        near[a, b] = 1 - again if one_less else again
    return rounded(near)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays."""
    square = np.zeros(len(matrix))
    for c in matrix.T:
        square += c * c
    length = np.sqrt(square)[:, None]
    return np.divide(matrix, length, out=matrix.copy(), where=length > 0)


def strips(spark: SparkSession, count: int, pairs: int, work: Callable[[int], Iterator[dict]], schema: str) -> DataFrame:
    """``work`` on each strip, over tasks of about TASK pairs: dealt so that early and late strips, of unlike lengths, meet."""
    tasks = max(1, min(count, max(-(-pairs // TASK), 2 * spark.sparkContext.defaultParallelism)))
    names = pa.schema([(f.name, {"bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[f.dataType.simpleString()]) for f in T._parse_datatype_string(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for strip in range(task, count, tasks):
                    for columns in work(strip):
                        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in names], schema=names)

    return spark.range(0, tasks if count else 0, 1, tasks).mapInArrow(run, schema)


def all_pairs(spark: SparkSession, vectors: Vectors, more: tuple[str, str] | None = None) -> DataFrame:
    """(u, v, score) of all pairs u < v, and their ``more`` columns under two names."""
    shared, n = spark.sparkContext.broadcast(vectors), len(vectors.ids)

    def work(strip: int) -> Iterator[dict]:
        h = shared.value
        lo, hi = strip * STRIP, min(n, (strip + 1) * STRIP)
        for left in range(lo, n, TILE):
            right = min(n, left + TILE)
            score = rounded_dots(h.matrix[lo:hi], h.matrix[left:right])
            i, j = np.nonzero(np.arange(lo, hi)[:, None] < np.arange(left, right)) if left < hi else (np.repeat(np.arange(hi - lo), right - left), np.tile(np.arange(right - left), hi - lo))
            columns = {"u": h.ids[lo + i], "v": h.ids[left + j], "score": score[i, j]}
            if more:
                columns |= {name: pa.array(h.more[at], mask=~h.known[at]) for name, at in zip(more, (lo + i, left + j), strict=True)}
            yield columns

    schema = "u long, v long, score double" + "".join(f", {name} long" for name in more or ())
    return strips(spark, -(-n // STRIP), n * n // 2, work, schema)


def count_above(spark: SparkSession, vectors: Vectors, bars: tuple[float, ...]) -> DataFrame:
    """(n, above0, above1, ...) by strips: pairs, and those that score more than each bar."""
    shared, n = spark.sparkContext.broadcast(vectors), len(vectors.ids)

    def work(strip: int) -> Iterator[dict]:
        h = shared.value
        lo, hi = strip * STRIP, min(n, (strip + 1) * STRIP)
        size = hi - lo
        got = np.zeros(len(bars), np.int64)
        for left in range(lo, n, TILE):
            score = rounded_dots(h.matrix[lo:hi], h.matrix[left : left + TILE])
            if left < hi:
                score[np.arange(lo, hi)[:, None] >= np.arange(left, left + score.shape[1])] = -np.inf
            got += [np.count_nonzero(score > bar) for bar in bars]
        yield {"n": [size * (n - hi) + size * (size - 1) // 2]} | {f"above{i}": [int(x)] for i, x in enumerate(got)}

    return strips(spark, -(-n // STRIP), n * n // 2, work, "n long" + "".join(f", above{i} long" for i in range(len(bars))))


def first(order: tuple[np.ndarray, ...], most: int) -> np.ndarray:
    """Positions of the first ``most`` by ascending keys, the leading one first."""
    at = np.arange(len(order[0]))
    if 0 < most < len(at):  # those after the last that can count go before the sort
        at = np.flatnonzero(order[0] <= np.partition(order[0], most - 1)[most - 1])
    return at[np.lexsort(tuple(k[at] for k in reversed(order)))[:most]]


def best_items(spark: SparkSession, users: Vectors, items: Vectors, most: int) -> DataFrame:
    """(user, item, score): for each user the ``most`` items of the largest product, ties to the smaller."""
    shared, n = spark.sparkContext.broadcast((users, items)), len(users.ids)

    def work(strip: int) -> Iterator[dict]:
        a, b = shared.value
        x = a.matrix[strip * STRIP : (strip + 1) * STRIP]
        row, far, at = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        bar = np.full((len(x), 1), np.inf)
        for left in range(0, len(b.ids), TILE):
            score = -rounded_dots(x, b.matrix[left : left + TILE])
            i, j = np.nonzero(score <= bar)
            row, far, at = np.append(row, i), np.append(far, score[i, j]), np.append(at, left + j)
            order = np.lexsort((at, far, row))
            place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            row, far, at, place = (c[place < most] for c in (row[order], far[order], at[order], place))
            full = place == most - 1
            bar[row[full], 0] = far[full]
        yield {"user": a.ids[strip * STRIP + row], "item": b.ids[at], "score": -far + 0.0}

    return strips(spark, -(-n // STRIP), n * len(items.ids), work, "user long, item long, score double")


def cell_pairs(spark: SparkSession, vectors: Vectors, groups: np.ndarray, named: np.ndarray, cells: list[tuple[int, int, int]], known: np.ndarray | None = None) -> DataFrame:
    """(u, v, score, g1, g2): of each cell (g1, g2, most), by minus the cosine distance, the first ``most`` of each strip by score, u and v,
    so the caller ranks what is left; ``groups`` has each position's group, where it is ``named``; ``known`` pairs (see ``fresh``) don't count."""
    members = {g: np.flatnonzero(named & (groups == g)) for g in {x for c in cells for x in c[:2]}}
    counts = np.array([-(-len(members[g1]) // STRIP) for g1, _, _ in cells], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    pairs = sum(len(members[g1]) * len(members[g2]) // (1 + (g1 == g2)) for g1, g2, _ in cells)
    shared, n = spark.sparkContext.broadcast((unit_rows(vectors.matrix), vectors.ids, members, cells, starts, known)), len(vectors.ids)

    def work(strip: int) -> Iterator[dict]:
        unit, ids, of, wanted, begin, without = shared.value
        c = int(np.searchsorted(begin, strip, "right")) - 1
        g1, g2, most = wanted[c]
        a = of[g1][(strip - begin[c]) * STRIP : (strip - begin[c] + 1) * STRIP]
        b = of[g2][np.searchsorted(of[g2], a[0]) :] if g1 == g2 else of[g2]
        held = (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for left in range(0, len(b), TILE):
            y = b[left : left + TILE]
            far = rounded_dots(unit[a], unit[y], one_less=True)
            take = a[:, None] < y if g1 == g2 else np.ones(far.shape, bool)
            if len(held[0]) >= most:
                take &= far <= held[0][most - 1]
            i, j = np.nonzero(take)
            keep = fresh(without, np.minimum(a[i], y[j]) * n + np.maximum(a[i], y[j]))
            i, j = i[keep], j[keep]
            u, v, d = np.minimum(a[i], y[j]), np.maximum(a[i], y[j]), far[i, j]
            both = tuple(np.append(x, y) for x, y in zip(held, (d, u, v), strict=True))
            keep = first(both, most)
            held = tuple(x[keep] for x in both)
        d, u, v = held
        yield {"u": ids[u], "v": ids[v], "score": -d, "g1": np.full(len(d), g1), "g2": np.full(len(d), g2)}

    return strips(spark, int(starts[-1]), pairs, work, "u long, v long, score double, g1 long, g2 long")


def fresh(known: np.ndarray | None, key: np.ndarray) -> np.ndarray:
    """Which keys of pairs (low position times the number of vectors plus the high one) are not among the ``known``, ascending."""
    if known is None or not len(known):
        return np.ones(len(key), bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] != key


def known_pairs(vectors: Vectors, edges: DataFrame) -> np.ndarray:
    """The keys of edges u < v."""
    ends = edges.where("u is not null and v is not null").select(F.col("u").cast("long"), F.col("v").cast("long")).toArrow()
    u, v = (vectors.places(ends.column(c).to_numpy()) for c in ("u", "v"))
    return np.unique((u * len(vectors.ids) + v)[(u >= 0) & (v > u)])


def close_leaves(spark: SparkSession, vectors: Vectors, leaves: list[np.ndarray], most: int, known: np.ndarray | None = None) -> DataFrame:
    """(u, v, distance): of the pairs inside each of some lists of positions, by cosine distance, the first ``most`` of each strip by
    distance, u and v, without the ``known`` (see ``fresh``). A pair in many
    leaves comes as often, so the caller takes distinct ones."""
    leaves = [x for x in leaves if len(x) > 1]
    starts = np.concatenate([[0], np.cumsum([-(-len(x) // STRIP) for x in leaves])]).astype(np.int64)
    pairs = sum(len(x) * (len(x) - 1) // 2 for x in leaves)
    shared, n = spark.sparkContext.broadcast((unit_rows(vectors.matrix), vectors.ids, leaves, starts, known)), len(vectors.ids)

    def work(strip: int) -> Iterator[dict]:
        unit, ids, of, begin, without = shared.value
        c = int(np.searchsorted(begin, strip, "right")) - 1
        b = of[c][(strip - begin[c]) * STRIP :]
        a = b[:STRIP]
        held = (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for left in range(0, len(b), TILE):
            y = b[left : left + TILE]
            far = rounded_dots(unit[a], unit[y], one_less=True)
            take = a[:, None] < y
            if len(held[0]) >= most:
                take &= far <= held[0][most - 1]
            i, j = np.nonzero(take)
            keep = fresh(without, a[i] * n + y[j])
            i, j = i[keep], j[keep]
            both = tuple(np.append(x, y) for x, y in zip(held, (far[i, j], a[i], y[j]), strict=True))
            keep = first(both, most)
            held = tuple(x[keep] for x in both)
        d, u, v = held
        yield {"u": ids[u], "v": ids[v], "distance": d}

    return strips(spark, int(starts[-1]), pairs, work, "u long, v long, distance double")


class Columns:
    """Sparse factors (node, c, f), all positive: rows by node, and each component's by falling f."""

    def __init__(self, node: np.ndarray, c: np.ndarray, f: np.ndarray):
        self.ids, self.node = np.unique(node, return_inverse=True)
        c = np.unique(c, return_inverse=True)[1]
        order = np.argsort(self.node, kind="stable")
        self.of, self.c, self.f = self.node[order].astype(np.int32), c[order].astype(np.int32), f[order]
        self.first = np.searchsorted(self.of, np.arange(len(self.ids) + 1))
        order = np.lexsort((-f, c))
        self.node, self.falling = self.node[order].astype(np.int32), -f[order]  # ascending, for searches
        self.begin = np.searchsorted(c[order], np.arange(int(c.max(initial=-1)) + 2))


def factor_terms(spark: SparkSession, columns: Columns, bar: float) -> DataFrame:
    """(u, v, score): sums over components of f_u f_v, of terms of at least ``bar``; pairs u < v that have one."""
    shared, n = spark.sparkContext.broadcast(columns), len(columns.ids)

    def work(strip: int) -> Iterator[dict]:
        h = shared.value
        for lo in range(strip * STRIP, min(n, (strip + 1) * STRIP), 16):
            hi = min(n, lo + 16)
            rows = slice(h.first[lo], h.first[hi])
            of, x, c = h.of[rows], h.f[rows], h.c[rows]
            size = np.zeros(len(x), np.int64)
            for k in range(len(x)):  # a little more than the terms that count
                own = h.falling[h.begin[c[k]] : h.begin[c[k] + 1]]
                size[k] = np.searchsorted(own, -bar / x[k] * (1 - 1e-12), "right")
            at = np.arange(int(size.sum())) + np.repeat(h.begin[c] - (np.cumsum(size) - size), size)
            u, v, term = np.repeat(of, size), h.node[at], np.repeat(x, size) * -h.falling[at]
            keep = (u < v) & (term >= bar)
            key, term = u[keep].astype(np.int64) * n + v[keep], term[keep]
            order = np.argsort(key, kind="stable")
            key, term = key[order], term[order]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            score = rounded(np.add.reduceat(term, begin)) if len(begin) else term
            yield {"u": h.ids[key[begin] // n], "v": h.ids[key[begin] % n], "score": score}

    terms = int(sum(np.searchsorted(columns.falling[a:b], -bar / -columns.falling[a:b], "right").sum() for a, b in zip(columns.begin[:-1], columns.begin[1:], strict=True)))
    return strips(spark, -(-n // STRIP), terms, work, "u long, v long, score double")
