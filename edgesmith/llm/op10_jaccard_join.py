"""N-gram Jaccard join by signature trees.

Two documents link when 100 * |x & y| >= percent * |x | y| for their sets of distinct word shingles.
The result is each document's component over those links.

1. Only documents that can have a partner go on. Hashes put shingles in one global order; partners
   share at least min(l(|x|), l(|y|)) of their first |x| - ceil(t|x|) + l(|x|) shingles, where l(n) is
   15 % of n, at least 1. Packs of documents ask buckets which of those shingles occur elsewhere; a
   document with too few is alone. No pair is lost: this is the prefix-filter bound, not a guess.
2. Equal sets become one node. Signature trees over groups of nodes find the links; a pair already in
   one component is skipped, so a group of near copies costs about one test a member. A leaf of a tree
   holds a few nodes, an inner node the OR of its token bitmaps, its range of set sizes and its most
   colliding bits. Two tree nodes can hold partners only if the bits they share, plus the fewer
   collisions, reach what their least sizes need. The dual traversal descends into such pairs alone,
   and the sets decide at the leaves.
3. First trees: nodes with the same smallest hash of their set, in two orders of the hashes. They join
   nearly all near copies early and prove nothing about the rest. A group beyond a tile is dealt into
   tiles, by other lots in each order, so that the second ties together what the first kept apart.
4. Then, for every link that may be missing: among the nodes' shingles those that occur once drop out;
   the rest, rarest first, give each node a prefix as in 1. A node goes on only if enough of its prefix
   is shared with another component, by the same bound. What is left is tied together by the shingles of
   the shortest prefixes that must meet and whose nodes are not all in one component by now. A group
   that fits in a tile is one tree. A larger one has one tree for each shingle instead, and one for all
   shingles with the same nodes. So chains of documents that share one passage each with the next never grow
   into one group. A shingle with more nodes than a tile is dealt into blocks, and every pair of blocks
   that may hold links between two components is traversed in its own task: split, whole, and exact.

What exact rests on: shingles are compared by 64-bit hashes, equal sets by 128 bits of two independent
families. Sets too small to link with a set that isn't equal to them (one and two shingles, at 75 %)
are compared by the 128 bits alone.

Defined results: texts with fewer words than a shingle have their whole word sequence as their one
shingle; null and empty texts and those without words have the empty set, link with nothing and form
their own components. Repeated rows count each. A null id takes its component's least id, or null.
An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import by_pack, discard, materialise, table, text_bytes
from .components import components
from .packs import MESSAGE, Digits, messages, spread, squeeze

PERCENT = 75
WIDTH = 5
PACK_BYTES = 4 << 20
LEAF = 16
TILE_NODES = 1024
TILE_TOKENS = 1 << 21
BANDS = 2
U = np.uint64


def _least_partner(n: np.ndarray, percent: int) -> np.ndarray:
    """Fewest shingles that a set of n must share with a partner, and the partner's least size."""
    return -(-n * percent // 100)


def _spare(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, n * 15 // 100)


def _set_keys(texts: pa.Array, width: int, first: list[np.ndarray]) -> list[bytes]:
    """128 bits of each set: sums over its hashes in two independent families."""
    other = kernels.shingle_sets(texts, width, kernels.OTHER)
    return [np.array([kernels.mix(a).sum(dtype=U), kernels.mix(b).sum(dtype=U)], U).tobytes() for a, b in zip(first, other, strict=True)]


def _band_keys(hashes: np.ndarray) -> list[int]:
    """The smallest hash of a set in each of BANDS orders."""
    return [int(kernels.mix(hashes ^ U(b)).min().astype(np.int64)) for b in range(BANDS)]


def _links_apart(n: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set of n can link with a set that is not equal to it: at best one with a single shingle more."""
    return 100 * n >= percent * (n + 1)


class Forest:
    """Union-find over positions."""

    def __init__(self, labels: np.ndarray):
        _, first, back = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[back]

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        """Roots of many rows at once."""
        out = self.up[rows]
        while (up := self.up[out]) is not None and (up != out).any():
            out = up
        self.up[rows] = out
        return out

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class SignatureTree:
    """Levels from the leaves up: OR of bitmaps, least and greatest size, most collisions."""

    def __init__(self, sets: list[np.ndarray], rows: np.ndarray, bits: int):
        self.sets = sets
        order = sorted(range(len(rows)), key=lambda k: (int(sets[rows[k]][0]), len(sets[rows[k]])))  # near copies side by side
        self.rows = rows[order]
        sizes = np.array([len(sets[i]) for i in self.rows], np.int64)
        maps = np.zeros((len(rows), bits), bool)
        for k, i in enumerate(self.rows):
            maps[k, (sets[i] & U(bits - 1)).astype(np.int64)] = True
        maps = np.packbits(maps, axis=1).view(U)
        lost = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, lost)]
        while len(maps) > 1:
            at = np.arange(0, len(maps), LEAF if len(self.levels) == 1 else 4)
            maps = np.bitwise_or.reduceat(maps, at)
            low, high, lost = np.minimum.reduceat(self.levels[-1][1], at), np.maximum.reduceat(self.levels[-1][2], at), np.maximum.reduceat(lost, at)
            self.levels.append((maps, low, high, lost))

    def fan(self, level: int) -> int:
        return LEAF if level == 1 else 4

    def width(self, level: int) -> int:
        return len(self.levels[level][0])


def _may(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether node pairs (i of level a, j of level b) can hold partners."""
    shared = np.bitwise_count(a[0][i] & b[0][j]).sum(1, dtype=np.int64) + np.minimum(a[3][i], b[3][j])
    most = np.minimum(shared, np.minimum(a[2][i], b[2][j]))
    least = a[1][i] + b[1][j]
    sizes = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
    return sizes & ((100 + percent) * most >= percent * least)


def traverse(x: SignatureTree, y: SignatureTree, forest: Forest, percent: int) -> list[tuple[int, int]]:
    """Links that join two components, between members of two trees over one list of sets (or of one)."""
    links, same = [], x is y
    depth = max(len(x.levels), len(y.levels)) - 1
    level = lambda t, d: min(d, len(t.levels) - 1)
    stack = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        d, i, j = stack.pop()
        a, b = level(x, d), level(y, d)
        ok = _may(x.levels[a], i, y.levels[b], j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if d == 0:
            u, v = x.rows[i], y.rows[j]
            apart = forest.roots(u) != forest.roots(v)
            for p, q in zip(u[apart].tolist(), v[apart].tolist(), strict=True):
                if forest.find(p) == forest.find(q):
                    continue
                s, t = (x.sets[p], x.sets[q]) if len(x.sets[p]) <= len(x.sets[q]) else (x.sets[q], x.sets[p])
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                if 100 * both >= percent * (len(s) + len(t) - both):
                    forest.join(p, q)
                    links.append((p, q))
            continue
        na, nb = level(x, d - 1), level(y, d - 1)
        fa = x.fan(a) if na < a else 1
        fb = y.fan(b) if nb < b else 1
        step = max(1, (1 << 15) // (fa * fb))
        for s in range(0, len(i), step):
            ci = (i[s : s + step, None] * fa + np.arange(fa)).repeat(fb, 1).ravel()
            cj = np.tile(j[s : s + step, None] * fb + np.arange(fb), fa).ravel()
            fit = (ci < x.width(na)) & (cj < y.width(nb))
            if same:
                fit &= (ci < cj) if d == 1 else (ci <= cj)
            ci, cj = ci[fit], cj[fit]
            if len(ci):
                stack.append((d - 1, ci, cj))
    return links


def _bits(sets: list[np.ndarray]) -> int:
    typical = float(np.median([len(s) for s in sets]))
    return 1 << min(14, max(8, math.ceil(math.log2(2 * typical + 1))))


def tree_links(sets: list[np.ndarray], labels: np.ndarray, parts: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join components, among all sets, or with ``parts`` (0 and 1) between the two parts."""
    forest, bits = Forest(labels), _bits(sets)
    if parts is None:
        tree = SignatureTree(sets, np.arange(len(sets)), bits)
        return traverse(tree, tree, forest, percent)
    one, two = (SignatureTree(sets, np.flatnonzero(parts == p), bits) for p in (0, 1))
    return traverse(one, two, forest, percent)


_FOUND = "id long, text_hash long, n long, key binary, bands array<long>, tokens binary"


def _partner_sets(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int, pack_bytes: int) -> DataFrame:
    """id, text_hash, n, key (of the set; null if the document is surely alone), bands and tokens (once a pack and key)."""
    total = text_bytes(docs, text_col)
    n_packs, codes = max(1, math.ceil(total / pack_bytes)), Digits(total, max(1, math.ceil(total / (2 * pack_bytes))))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("id", F.lit(10)), F.lit(n_packs)).alias("g"), "id", "text", F.xxhash64("text").alias("text_hash"))
    packs = by_pack(rows, n_packs).groupBy("g")

    def sets_of(rows: pa.Table) -> list[np.ndarray]:
        return list(kernels.shingle_sets(rows.column("text"), width))

    def ahead(s: np.ndarray) -> np.ndarray:
        n = np.int64(len(s))
        return codes.short(s[: n - _least_partner(n, percent) + _spare(n)])

    def ask(rows: pa.Table) -> pa.Table:
        found = [ahead(s) for s in sets_of(rows) if len(s)]
        return codes.deal(rows.column("g")[0].as_py(), np.unique(np.concatenate([np.zeros(0, U), *found])))

    def answer(rows: pa.Table, hits: pa.Table) -> pa.Table:
        sets, known = sets_of(rows) if rows.num_rows else [], codes.told(hits)
        # digits in two texts of this pack, copies of one set included
        asked = [np.unique(ahead(s)) if len(s) else np.zeros(0, U) for s in sets]
        local = np.sort(np.concatenate([np.zeros(0, U), *asked]))
        known = np.union1d(known, local[1:][local[1:] == local[:-1]])
        met = np.isin(np.concatenate([np.zeros(0, U), *asked]), known)
        met = np.concatenate([[0], np.cumsum(met)])[np.concatenate([[0], np.cumsum([len(x) for x in asked], dtype=np.int64)])]
        n = np.array([len(s) for s in sets], np.int64)
        fit = np.flatnonzero((n > 0) & (np.diff(met) >= _spare(_least_partner(n, percent))))
        keys = _set_keys(rows.column("text").take(pa.array(fit, pa.int64())), width, [sets[i] for i in fit]) if len(fit) else []
        out_key, out_bands, out_tokens, lead = [None] * len(sets), [None] * len(sets), [None] * len(sets), set()
        for i, k in zip(fit.tolist(), keys, strict=True):
            out_key[i] = k
            if k not in lead:
                lead.add(k)
                out_bands[i], out_tokens[i] = _band_keys(sets[i]), sets[i].astype("<u8").tobytes()
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        return pa.table([rows.column("id"), rows.column("text_hash"), *(pa.array(c, t) for c, t in zip((n, out_key, out_bands, out_tokens), kinds, strict=True))], ["id", "text_hash", "n", "key", "bands", "tokens"])

    hits = by_pack(packs.applyInArrow(ask, MESSAGE), codes.n_buckets, "bucket").groupBy("bucket").applyInArrow(lambda rows: codes.repeated(rows), MESSAGE)
    return packs.cogroup(hits.groupBy("g")).applyInArrow(answer, _FOUND)


def _postings(nodes: DataFrame, n_tokens: int, percent: int) -> DataFrame:
    """(token, node, head): each node's prefix, rarest shingles first, without those that no other node has. ``head``
    marks the shortest prefix, of which partners share one."""
    n_packs = max(1, math.ceil(8 * n_tokens / (2 * PACK_BYTES)))
    n_buckets = n_packs
    packs = by_pack(nodes.select(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(n_packs)).alias("g"), "node", "tokens"), n_packs).groupBy("g")

    def tokens_of(rows: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(t, "<u8").astype(U) for t in rows.column("tokens").to_pylist()]

    def tell(rows: pa.Table) -> pa.Table:
        keys, counts = np.unique(np.concatenate(tokens_of(rows)), return_counts=True)
        home = (keys % U(n_buckets)).astype(np.int64)
        out = [(int(b), squeeze(keys[home == b], counts[home == b].astype("<i4"))) for b in np.unique(home)]
        return messages([b for b, _ in out], [rows.column("g")[0].as_py()] * len(out), [z for _, z in out])

    def add(rows: pa.Table) -> pa.Table:
        lots = [spread(b, "<u8", "<i4") for b in rows.column("blob").to_pylist()]
        keys, back = np.unique(np.concatenate([x[0] for x in lots]), return_inverse=True)
        sums = np.bincount(back, np.concatenate([x[1] for x in lots]).astype(np.float64)).astype(np.int64)
        out, at = [], 0
        for keep, _ in lots:
            n = sums[back[at : at + len(keep)]]
            at += len(keep)
            out.append(squeeze(keep[n > 1], np.minimum(n[n > 1], np.iinfo(np.int32).max).astype("<i4")))
        return messages([0] * len(out), rows.column("g").to_pylist(), out)

    def choose(rows: pa.Table, told: pa.Table) -> pa.Table:
        lots = [spread(b, "<u8", "<i4") for b in told.column("blob").to_pylist()]
        keys = np.concatenate([np.zeros(0, U), *(x[0].astype(U) for x in lots)])
        often = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in lots)])
        order = np.argsort(keys)
        keys, often = keys[order], often[order]
        out_t, out_n, out_h = [], [], []
        for node, t in zip(rows.column("node").to_pylist(), tokens_of(rows) if rows.num_rows else [], strict=True):
            at = np.searchsorted(keys, t)
            found = np.zeros(len(t), bool)
            inside = at < len(keys)
            found[inside] = keys[at[inside]] == t[inside]
            df = np.ones(len(t), np.int64)
            df[found] = often[at[found]]
            n = np.int64(len(t))
            short = int(n - _least_partner(n, percent)) + 1
            first = np.lexsort((t, df))[: short - 1 + int(_spare(n))]
            keep = df[first] > 1
            out_t.append(t[first][keep].view(np.int64))
            out_n.append(np.full(len(out_t[-1]), node, np.int64))
            out_h.append(np.flatnonzero(keep) < short)
        empty = np.zeros(0, np.int64)
        return pa.table([np.concatenate([empty, *out_t]), np.concatenate([empty, *out_n]), np.concatenate([np.zeros(0, bool), *out_h])], ["token", "node", "head"])

    told = by_pack(packs.applyInArrow(tell, MESSAGE), n_buckets, "bucket").groupBy("bucket").applyInArrow(add, MESSAGE)
    return packs.cogroup(told.groupBy("g")).applyInArrow(choose, "token long, node long, head boolean")


_LINKS = "a long, b long"


def _solver(percent: int):
    def solve(rows: pa.Table) -> pa.Table:
        """Trees of one bin: rows are (bin, tree, part, label, node, tokens); part is null for one tree."""
        trees: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(rows.column("tree").to_pylist(), rows.column("tile").to_pylist(), strict=True)):
            trees.setdefault(key, []).append(i)
        nodes, labels = rows.column("node").to_numpy(), rows.column("label").to_numpy()
        parts, tokens = rows.column("part").to_numpy(), rows.column("tokens")
        a, b = [], []
        for members in trees.values():
            m = np.array(members)
            if len(m) < 2:
                continue
            sets = [np.frombuffer(tokens[i].as_buffer(), "<u8").astype(U) for i in members]
            part = parts[m] if (parts[m] >= 0).all() else None
            for p, q in tree_links(sets, labels[m], part, percent):
                a.append(int(nodes[m[p]]))
                b.append(int(nodes[m[q]]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return solve


def _tiles(c: str, s: str, tile_nodes: int, tile_tokens: int):
    return F.greatest(F.ceil(F.col(c) / tile_nodes), F.ceil(F.col(s) / tile_tokens)).cast("long")


def _early_links(nodes: DataFrame, percent: int, n_bins: int, tile_nodes: int, tile_tokens: int, scratch: list[str]) -> DataFrame:
    """Links found by trees over nodes (node, n, bands, tokens) with a smallest hash in common."""
    banded = lambda *columns: nodes.select("node", "n", *columns, F.posexplode("bands").alias("band", "tree"))
    sizes = banded().groupBy("band", "tree").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).withColumn("tiles", _tiles("c", "s", tile_nodes, tile_tokens))
    # written out: one row for each group beyond a tile, to be broadcast by its size or joined with the hot side split
    hot = materialise(sizes.where("tiles > 1").select(F.col("band").alias("_band"), F.col("tree").alias("_tree"), "tiles"), scratch)
    dealt = banded("tokens").join(hot, (F.col("band") == F.col("_band")) & (F.col("tree") == F.col("_tree")), "left")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("node", "band"), F.coalesce("tiles", F.lit(1))))
    dealt = dealt.select(F.xxhash64("band", "tree").alias("tree"), "tile", F.lit(-1).alias("part"), F.col("node").alias("label"), "node", "tokens")
    bins = dealt.groupBy(F.pmod(F.xxhash64("tree", "tile", F.lit(4)), F.lit(n_bins)).alias("bin"))
    return materialise(bins.applyInArrow(_solver(percent), _LINKS), scratch)


def _late_links(nodes: DataFrame, labels: DataFrame, percent: int, n_tokens: int, n_bins: int, tile_nodes: int, tile_tokens: int, scratch: list[str]) -> DataFrame | None:
    """All links that the components in ``labels`` still miss, or None if no prefix shingle spans two of them."""
    posts = materialise(_postings(nodes, n_tokens, percent), scratch)
    parts = materialise(nodes.select("node", "n").join(labels, "node", "left").select("node", "n", F.coalesce("label", "node").alias("part_of")), scratch)
    least = F.expr(f"(n * {percent} + 99) div 100")
    need = F.greatest(F.lit(1).cast("long"), (least * 15 / 100).cast("long"))
    spans = lambda of: of.groupBy("token").agg(F.min("part_of").alias("low"), F.max("part_of").alias("high")).where("low <> high").select("token")
    for _ in range(2):  # the second time without what only nodes that went had in common
        met = posts.join(spans(posts.join(parts, "node")), "token", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("met"))
        parts = materialise(parts.join(met, "node").where(F.col("met") >= need).select("node", "n", "part_of"), scratch)
    heads = materialise(posts.where("head").select("token", "node").join(parts, "node"), scratch)
    lists = heads.groupBy("token").agg(
        F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), F.min("part_of").alias("low"), F.max("part_of").alias("high"), F.min("node").alias("centre"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("x2"),
    ).where("low <> high")
    lists = lists.groupBy("x1", "x2", "c", "s").agg(F.min("token").alias("token"), F.first("centre").alias("centre"))
    lists = materialise(lists.select("token", "centre", _tiles("c", "s", tile_nodes, tile_tokens).alias("tiles")), scratch)
    if lists.limit(1).count() == 0:
        return None
    tied = heads.join(lists.select("token", "centre"), "token").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    groups = components(tied, scratch).withColumnRenamed("label", "tree")
    sizes = groups.join(parts, "node").groupBy("tree").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).select("tree", _tiles("c", "s", tile_nodes, tile_tokens).alias("group_tiles"))
    groups = materialise(groups.join(sizes, "tree"), scratch)
    whole = groups.where("group_tiles = 1").join(parts, "node").select("tree", F.lit(-1).alias("tile"), F.lit(1).cast("long").alias("tiles"), "node", "n", "part_of")
    single = lists.join(groups.where("group_tiles > 1").select(F.col("node").alias("centre")), "centre").select("token", "tiles")
    single = heads.join(single, "token").select(F.col("token").alias("tree"), F.lit(0).alias("tile"), "tiles", "node", "n", "part_of")
    members = materialise(whole.unionByName(single).join(nodes.select("node", "tokens"), "node"), scratch)
    small = members.where("tiles = 1").select("tree", "tile", F.lit(-1).alias("part"), F.col("part_of").alias("label"), "node", "tokens")
    links = small.groupBy(F.pmod(F.xxhash64("tree", "tile", F.lit(4)), F.lit(n_bins)).alias("bin")).applyInArrow(_solver(percent), _LINKS)
    large = members.where("tiles > 1")
    if large.limit(1).count():
        links = links.unionByName(_block_links(large, percent, tile_nodes, tile_tokens, scratch))
    return materialise(links, scratch)


def _block_links(large: DataFrame, percent: int, tile_nodes: int, tile_tokens: int, scratch: list[str]) -> DataFrame:
    """Links between components among trees of several tiles: pairs of blocks, but for those that hold one component only
    or sets too unlike in size. Blocks follow the sets' sizes, so most pairs of them do."""
    per = large.groupBy("tree", "part_of").agg(F.count(F.lit(1)).alias("pc"), F.sum("n").alias("ps")).withColumn("share", _tiles("pc", "ps", tile_nodes, tile_tokens))
    own = (2 * F.col("pc") >= tile_nodes) | (2 * F.col("ps") >= tile_tokens)  # a component that fills tiles of its own
    large = large.join(per.select("tree", "part_of", own.alias("own"), "share"), ["tree", "part_of"])
    # within a class of sizes of which the largest is a third above the least
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent))
    sizes = large.where("not own").groupBy("tree", size.alias("size")).agg(F.count(F.lit(1)).alias("mc"), F.sum("n").alias("ms")).withColumn("lots", _tiles("mc", "ms", tile_nodes, tile_tokens)).select("tree", "size", "lots")
    large = large.withColumn("size", size).join(sizes, ["tree", "size"], "left")
    mine = F.xxhash64("part_of", F.pmod(F.xxhash64("node", F.lit(8)), F.col("share")))
    mixed = F.xxhash64(F.lit("mixed"), F.col("size"), F.pmod(F.xxhash64("part_of"), F.col("lots")))
    large = materialise(large.select("tree", F.when(F.col("own"), mine).otherwise(mixed).alias("block"), "part_of", "node", "n", "tokens"), scratch)
    blocks = large.groupBy("tree", "block").agg(F.min("part_of").alias("p0"), F.max("part_of").alias("p1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    blocks = materialise(blocks, scratch)
    left, right = (blocks.select(F.col("tree"), *[F.col(c).alias(f"{c}_{s}") for c in ("block", "p0", "p1", "n0", "n1")]) for s in ("x", "y"))
    apart = ~((F.col("p0_x") == F.col("p1_x")) & (F.col("p0_y") == F.col("p1_y")) & (F.col("p0_x") == F.col("p0_y")))
    near = (100 * F.col("n1_x") >= percent * F.col("n0_y")) & (100 * F.col("n1_y") >= percent * F.col("n0_x"))
    pairs = left.join(right, "tree").where((F.col("block_x") <= F.col("block_y")) & apart & near).select("tree", "block_x", "block_y", F.xxhash64("block_x", "block_y").alias("tile"))
    pairs = materialise(pairs, scratch)
    alone = F.col("block_x") == F.col("block_y")
    end = lambda c, part: F.struct(F.col(c).alias("block"), F.lit(part).alias("part"))
    ends = pairs.select("tree", "tile", F.explode(F.when(alone, F.array(end("block_x", -1))).otherwise(F.array(end("block_x", 0), end("block_y", 1)))).alias("e"))
    tasks = ends.select("tree", "tile", "e.block", "e.part").join(large, ["tree", "block"]).select("tree", "tile", "part", F.col("part_of").alias("label"), "node", "tokens")
    return tasks.groupBy("tree", "tile").applyInArrow(_solver(percent), _LINKS)


def _labels(nodes: DataFrame, percent: int, tile_nodes: int, tile_tokens: int, scratch: list[str]) -> DataFrame:
    """(node, label) for every node (node, n, bands, tokens) that links with another."""
    able = nodes.where(_links_apart(F.col("n"), percent))
    n_tokens = able.agg(F.sum("n")).first()[0] or 0
    n_bins = max(1, math.ceil(8 * n_tokens / (2 * PACK_BYTES)))
    early = _early_links(able, percent, n_bins, tile_nodes, tile_tokens, scratch)
    labels = components(early, scratch)
    late = _late_links(able, labels, percent, n_tokens, n_bins, tile_nodes, tile_tokens, scratch)
    return labels if late is None else components(early.unionByName(late), scratch)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH, pack_bytes: int = PACK_BYTES, tile_nodes: int = TILE_NODES, tile_tokens: int = TILE_TOKENS) -> DataFrame:
    """id, text_hash (xxhash64 of the text), n_shingles, component (any node of it; null: alone) and
    component_id for every input row."""
    spark, scratch = docs.sparkSession, []
    found = materialise(_partner_sets(docs, id_col, text_col, percent, width, pack_bytes), scratch)
    nodes = found.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands", ignorenulls=True).alias("bands"), F.first("tokens", ignorenulls=True).alias("tokens"))
    # numbers, not hashes of keys: no two sets share one. Written out, they hold for good
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), scratch)
    # the rows without their shingles; the shingles themselves are from here on those of the nodes
    rows = materialise(found.select("id", "text_hash", "n", "key"))
    discard(spark, scratch, last=1)
    labels = _labels(nodes.select("node", "n", "bands", "tokens"), percent, tile_nodes, tile_tokens, scratch)
    named = nodes.select("key", "node", "rep").join(labels, "node", "left").select("key", "rep", F.coalesce("label", "node").alias("label"))
    named = materialise(named)
    discard(spark, scratch)
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    ids = named.join(least, "label").select("key", "label", "component_id")
    out = rows.join(ids, "key", "left")
    return out.select("id", "text_hash", F.col("n").alias("n_shingles"), F.col("label").alias("component"), F.coalesce("component_id", "id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


#: DuckDB: words compared as words, all pairs that share a shingle, and who reaches whom.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                       ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM d),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
b AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.rid <> y.rid GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM b JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
r(a, b) AS (SELECT rid, rid FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT r.a AS rid, min(o.doc_id) AS component_id FROM r JOIN d o ON o.rid = r.b GROUP BY r.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (rid) JOIN m USING (rid)"""
