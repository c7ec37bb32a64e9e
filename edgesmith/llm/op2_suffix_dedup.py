"""Suffix-array dedup: remove passages that an earlier document also holds.

Suffixes are ordered only through ``threshold`` bytes, by most-significant-digit passes, and equal
groups are exactly the repeated windows:

1. The first digit is a hash of ``gram`` bytes (ordering all suffixes by their leading bytes would send
   every byte of the input several times). Every window of ``threshold`` bytes holds a smallest-hash
   gram, its anchor, chosen from the window's own bytes alone, so equal windows hold the same anchor at
   the same place. Only about one suffix in thirteen starts at an anchor; these are dealt to buckets by
   digit, and digits found once drop out (a singleton group of a radix pass).
2. The suffixes that are left meet in their digit's bucket with the bytes around them, and passes of
   eight bytes refine the groups: first the anchor itself, then the bytes after it, then those before
   it, backwards. Groups of one document drop out. What remains is compared byte by byte; hashes
   only deal out work.
3. A digit with more than ``crowd`` suffixes in different surroundings (a rule of dashes, a common line)
   is dealt on by its next digit: each window around such an anchor goes to the bucket of its own
   ``threshold`` bytes, where the equal ones meet. So no bucket holds a whole crowd, and none is left out.
4. Each pack of documents takes the covered spans back and cuts them from its texts.

Before a shuffle each pack keeps one suffix for each distinct surrounding, that of the smallest id,
so a passage in a third of all documents sends one row a pack. Nothing is capped or sampled. Packs
and buckets are sized in bytes, so their number grows with the input and their size doesn't.

Defined results: null and empty texts count as no bytes, as do all texts shorter than the threshold
for removal. A passage goes only where a *smaller* id holds it, so repeated rows with one id leave
each other alone. A null id counts as larger than all others. Other columns come back untouched in
the struct ``carry``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import by_pack, table, text_bytes
from .packs import MESSAGE, Digits, messages, spread, squeeze

THRESHOLD = 50
GRAM = 24
PACK_BYTES = 4 << 20
#: Suffixes of one digit, in different surroundings, that one bucket takes.
CROWD = 1 << 14
LAST = np.iinfo(np.int64).max
U = np.uint64


def anchors(data: np.ndarray, offsets: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that are a smallest gram of some whole window inside one text, and their digits."""
    n, span = len(data), threshold - gram + 1
    if n < threshold:
        return np.zeros(0, np.int64), np.zeros(0, U)
    digits = kernels.window_hashes(data, gram)
    least = kernels.sliding(digits, span)
    valid = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= threshold)
    np.add.at(valid, offsets[long], 1)
    np.add.at(valid, offsets[long + 1] - threshold + 1, -1)
    least = np.where(np.cumsum(valid)[: len(least)] > 0, least, U(0))
    pad = np.zeros(span - 1, U)
    most = kernels.sliding(np.concatenate([pad, least, pad]), span, np.maximum)
    at = np.flatnonzero((digits == most[: len(digits)]) & (most[: len(digits)] > 0))
    return at, digits[at]


def _around(data: np.ndarray, at: np.ndarray, threshold: int, gram: int) -> np.ndarray:
    """A hash of the bytes on both sides of each anchor, to count in how many surroundings a digit stands."""
    sides = kernels.window_hashes(data, threshold - gram)
    if not len(at):
        return np.zeros(0, U)
    return kernels.mix(sides[np.maximum(at - threshold + gram, 0)]) + sides[np.minimum(at + gram, len(sides) - 1)]


class _Pack:
    """The documents of one pack in a fixed order, with their anchors."""

    def __init__(self, rows: pa.Table, threshold: int, gram: int, anchored: bool = True):
        ids = [LAST if x is None else x for x in rows.column("id").to_pylist()]
        texts = [x or "" for x in rows.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.rows = rows.take(pa.array(order, pa.int64()))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.data, self.offsets = kernels.buffers(pa.array([texts[i] for i in order], pa.large_string()))
        if anchored:
            found = []
            for i, j in kernels.chunks(self.offsets):
                a, b = self.offsets[i], self.offsets[j]
                at, digits = anchors(self.data[a:b], self.offsets[i : j + 1] - a, threshold, gram)
                found.append((at + a, digits, _around(self.data[a:b], at, threshold, gram)))
            self.at = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
            self.digits, self.around = (np.concatenate([f[k] for f in found] or [np.zeros(0, U)]) for k in (1, 2))
            self.doc = np.searchsorted(self.offsets, self.at, "right") - 1


def _refine(groups: np.ndarray, digit: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One radix pass: rows in order of (group, digit), and their new groups."""
    order = np.lexsort((digit, groups))
    rows, groups, digit = rows[order], groups[order], digit[order]
    new = np.ones(len(rows), bool)
    new[1:] = (groups[1:] != groups[:-1]) | (digit[1:] != digit[:-1])
    return rows, np.cumsum(new) - 1


def _shared(groups: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a row's group has two ids; groups stand together."""
    if not len(groups):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    low, high = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
    return np.repeat(low < high, np.diff(np.append(first, len(groups))))


def _order(digits: list[np.ndarray], start: np.ndarray, rows: np.ndarray, ids: np.ndarray, drop: bool) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over rows; with drop, groups of one document leave after each."""
    groups = start
    for d in digits:
        rows, groups = _refine(groups, d[rows], rows)
        if drop:
            stay = _shared(groups, ids[rows])
            rows, groups = rows[stay], groups[stay]
    return rows, groups


def _covered(records: np.ndarray, ids: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix with its surroundings, the least and the greatest number of bytes before the
    anchor at which a window starts that a smaller id holds too (least above greatest: none).

    A record holds threshold - gram bytes before the anchor, the anchor, as many bytes after it, and
    how many of each side are really the text's.
    """
    n, side = len(records), threshold - gram
    low, high = np.full(n, side + 1, np.int32), np.full(n, -1, np.int32)
    left, right = records[:, -2].astype(np.int32), records[:, -1].astype(np.int32)
    before, after = np.ascontiguousarray(records[:, :side][:, ::-1]), np.ascontiguousarray(records[:, side + gram : 2 * side + gram])
    rows, groups = _order(_words(records[:, side : side + gram]), np.zeros(n, np.int64), np.arange(n), ids, True)
    if not len(rows):
        return low, high
    anchor = np.full(n, -1, np.int64)
    anchor[rows] = groups
    # Suffixes with the same surroundings: the first of the smallest id leads them.
    ends = left.astype(U) << U(8) | right.astype(U)
    same, names = _order([*_words(after), *_words(before), ends], groups, rows, ids, False)
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    sizes = np.diff(np.append(first, len(names)))
    later = ids[same] > np.repeat(np.minimum.reduceat(ids[same], first), sizes)
    cls = np.repeat(np.arange(len(first)), sizes)
    own = np.flatnonzero(~later)
    lead = np.empty(len(first), np.int64)
    lead[cls[own][::-1]] = same[own][::-1]
    leaders = lead
    seat = np.empty(n, np.int64)
    seat[leaders] = np.arange(len(leaders))
    # Names of (anchor, next r bytes) and (anchor, last r bytes) for each r, from two sorted orders.
    named = {}
    for key, part in (("after", after), ("before", before)):
        r, _ = _order(_words(part), anchor[leaders], leaders, ids, False)
        new = np.concatenate([[True], anchor[r][1:] != anchor[r][:-1]])
        differ = part[r][1:] != part[r][:-1]
        common = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), side)]) if side else np.zeros(len(r), np.int64)
        named[key] = (seat[r], new, common)
    who, l, r = ids[leaders], left[leaders], right[leaders]
    lo, hi = np.full(len(leaders), side + 1, np.int32), np.full(len(leaders), -1, np.int32)

    def names_of(key: str, size: int) -> np.ndarray:
        seats, new, common = named[key]
        out = np.empty(len(leaders), np.int64)
        out[seats] = np.cumsum(new | (common < size))
        return out

    for o in range(side + 1):
        fit = np.flatnonzero((l >= o) & (r >= side - o))
        if not len(fit):
            continue
        key = names_of("after", side - o)[fit] * (len(leaders) + 1) + names_of("before", o)[fit]
        order = np.argsort(key, kind="stable")
        key, holder = key[order], who[fit][order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.repeat(np.minimum.reduceat(holder, start), np.diff(np.append(start, len(key))))
        hit = fit[order[holder > least]]
        lo[hit], hi[hit] = np.minimum(lo[hit], o), o
    low[same], high[same] = lo[seat[lead[cls]]], hi[seat[lead[cls]]]
    w = same[later]  # all their windows stand in the leader's document
    low[w], high[w] = np.maximum(0, side - right[w]), np.minimum(side, left[w])
    return low, high


def _words(part: np.ndarray) -> list[np.ndarray]:
    """Bytes as big-endian digits of eight."""
    wide = np.ascontiguousarray(np.pad(part, ((0, 0), (0, -part.shape[1] % 8))))
    return list(wide.view(">u8").astype(U).T)


def _records(pack: _Pack, at: np.ndarray, doc: np.ndarray, threshold: int, gram: int) -> np.ndarray:
    side = threshold - gram
    left = np.minimum(side, at - pack.offsets[doc])
    right = np.minimum(side, pack.offsets[doc + 1] - at - gram)
    out = np.zeros((len(at), 2 * side + gram + 2), np.uint8)
    for lo in range(0, len(at), 1 << 14):
        s = slice(lo, lo + (1 << 14))
        near = at[s, None] + np.arange(-side, side + gram)
        out[s, :-2] = pack.data[np.clip(near, 0, len(pack.data) - 1)]
        ahead = np.arange(2 * side + gram)
        out[s, :-2][(ahead < side - left[s, None]) | (ahead >= side + gram + right[s, None])] = 0
    out[:, -2], out[:, -1] = left, right
    return out


def _digest(records: np.ndarray) -> np.ndarray:
    out = np.zeros(len(records), U)
    for w in _words(records):
        out = kernels.mix(out ^ w) + w
    return out


def _collapse(records: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each record the row of the first one of the smallest id with the same bytes."""
    key = _digest(records)
    order = np.lexsort((np.arange(len(ids)), ids, key))
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    alike = (records[order] == records[lead]).all(1)
    out = np.empty(len(ids), np.int64)
    out[order] = np.where(alike, lead, order)  # differing bytes under one digest stand for themselves
    return out


def _same_windows(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their bytes, by radix passes, and the group of equal bytes that each is in."""
    return _order(_words(windows), np.zeros(len(windows), np.int64), np.arange(len(windows)), np.zeros(0, np.int64), False)


def _held_before(rows: np.ndarray, groups: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window whether a smaller id has the same bytes."""
    out = np.zeros(len(ids), bool)
    if len(rows):
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        least = np.repeat(np.minimum.reduceat(ids[rows], first), np.diff(np.append(first, len(rows))))
        out[rows] = ids[rows] > least
    return out


def _spans_of(low: np.ndarray, high: np.ndarray, at: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the matching windows around each anchor cover: they overlap, so they are one run."""
    return at - high, at - low + threshold


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, gram: int = GRAM, pack_bytes: int = PACK_BYTES, with_text: bool = True, crowd: int = CROWD) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, the removed ``spans``
    (byte ranges), ``kept_text`` (a character cut in two is dropped; null without ``with_text``) and
    ``carry``, the input's other columns."""
    if not 0 < threshold - gram < 256 or gram < 1:
        raise ValueError("gram must be below threshold by 1 to 255")
    total = text_bytes(docs, text_col)
    n_packs = max(1, math.ceil(total / pack_bytes))
    n_buckets = max(1, math.ceil(total / (2 * pack_bytes)))
    codes = Digits(total, n_buckets)
    others = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.lit(7)), F.lit(n_packs)).alias("g"),
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.struct(*(others or [F.lit(None).cast("int").alias("none")])).alias("carry"),
    )
    packs = by_pack(rows, n_packs).groupBy("g")

    def first_digits(rows: pa.Table) -> pa.Table:
        """Distinct digits of a pack, to their buckets, each with the number of its surroundings here."""
        pack = _Pack(rows, threshold, gram)
        order = np.lexsort((pack.around, digits := codes.short(pack.digits)))
        digits, around = digits[order], pack.around[order]
        new = np.ones(len(digits), bool)
        new[1:] = (digits[1:] != digits[:-1]) | (around[1:] != around[:-1])
        keys, counts = np.unique(digits[new], return_counts=True)
        home, g = codes.home(keys), rows.column("g")[0].as_py()
        order = np.argsort(home, kind="stable")
        buckets, where = np.unique(home[order], return_index=True)
        parts = np.split(order, where[1:]) if len(buckets) else []
        return messages(buckets.tolist(), [g] * len(buckets), [squeeze(codes.to_bytes(keys[p]), counts[p].astype("<i4")) for p in parts])

    def repeated(rows: pa.Table) -> pa.Table:
        """In a bucket: tell each pack which of its digits another pack has too, and which are crowds."""
        lots = [spread(b, "u1", "<i4") for b in rows.column("blob").to_pylist()]
        lists = [codes.from_bytes(x[0]) for x in lots]
        keys, back, packs_with = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        crowds = np.bincount(back, np.concatenate([x[1] for x in lots]).astype(np.float64)) > crowd
        out_g, out_b, at = [], [], 0
        for g, digits in zip(rows.column("g").to_pylist(), lists, strict=True):
            which = back[at : at + len(digits)]
            at += len(digits)
            keep = packs_with[which] > 1
            if keep.any():
                out_g.append(g)
                out_b.append(squeeze(codes.to_bytes(digits[keep]), crowds[which[keep]]))
        return messages([0] * len(out_g), out_g, out_b)

    def windows_of(pack: _Pack, records: np.ndarray, doc: np.ndarray, local: np.ndarray, g: int) -> tuple[list, list, list]:
        """Messages with every window around the anchors of crowds, to the bucket of its bytes; what a smaller id of
        this pack holds is told to the pack at once, and only the first of equal ones is sent."""
        side = threshold - gram
        left, right = records[:, -2].astype(np.int64), records[:, -1].astype(np.int64)
        who, starts, parts = [], [], []
        for o in range(side + 1):
            fit = np.flatnonzero((left >= o) & (right >= side - o))
            who.append(doc[fit])
            starts.append(local[fit] - o)
            parts.append(records[fit, side - o : side - o + threshold])
        who, starts, windows = np.concatenate(who), np.concatenate(starts), np.concatenate(parts)
        if not len(who):
            return [], [], []
        rows, names = _same_windows(windows)
        held = _held_before(rows, names, pack.ids[who])
        span = lambda at: squeeze(who[at].astype("<i4"), starts[at].astype("<i8"), (starts[at] + threshold).astype("<i8"))
        buckets, gs, blobs = [-1 - g], [g], [span(np.flatnonzero(held))]
        # the rest, in the order of bytes: windows of the smallest id that has them here
        stay = ~held[rows]
        rows, names = rows[stay], names[stay]
        lead = np.concatenate([[True], names[1:] != names[:-1]]) if len(rows) else np.zeros(0, bool)
        home = codes.home(_digest(windows[rows[lead]]))
        group = np.cumsum(lead) - 1
        place, where = np.empty(len(home), np.int64), home[group] if len(rows) else home
        for bucket in np.unique(home):
            mine, members = np.flatnonzero(home == bucket), np.flatnonzero(where == bucket)
            place[mine] = np.arange(len(mine))
            at = rows[members]
            buckets.append(n_buckets + int(bucket))
            gs.append(g)
            blobs.append(squeeze(windows[rows[lead][mine]], pack.ids[who[rows[lead][mine]]].astype("<i8"), place[group[members]].astype("<i4"), who[at].astype("<i4"), starts[at].astype("<i8")))
        return buckets, gs, blobs

    def suffixes(rows: pa.Table, hits: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return messages([], [], [])
        g = rows.column("g")[0].as_py()
        pack = _Pack(rows, threshold, gram)
        digits = codes.short(pack.digits)
        told = [spread(b, "u1", "?") for b in hits.column("blob").to_pylist()]
        known, crowds = (np.concatenate([np.zeros(0, k), *x]) for k, x in ((U, [codes.from_bytes(t[0]) for t in told]), (bool, [t[1] for t in told])))
        keys, inverse = np.unique(digits, return_inverse=True)
        ids = pack.ids[pack.doc]
        small, large = np.full(len(keys), LAST, np.int64), np.full(len(keys), np.iinfo(np.int64).min, np.int64)
        np.minimum.at(small, inverse, ids)
        np.maximum.at(large, inverse, ids)
        take = np.flatnonzero(((small < large) | np.isin(keys, known))[inverse])
        if not len(take):
            return messages([], [], [])
        at, doc, ids, digits = pack.at[take], pack.doc[take], ids[take], digits[take]
        crowded = np.isin(digits, known[crowds])
        records = _records(pack, at, doc, threshold, gram)
        lead = _collapse(records, ids)
        local = (at - pack.offsets[doc]).astype(np.int64)
        buckets, gs, blobs = [], [], []
        later = np.flatnonzero(ids > ids[lead])  # wholly held by a smaller id of this pack
        if len(later):
            side = threshold - gram
            low, high = np.maximum(0, side - records[later, -1].astype(np.int32)), np.minimum(side, records[later, -2].astype(np.int32))
            a, b = _spans_of(low, high, local[later], threshold)
            ok = low <= high
            buckets, gs, blobs = [-1 - g], [g], [squeeze(doc[later][ok].astype("<i4"), a[ok].astype("<i8"), b[ok].astype("<i8"))]
        first = ids == ids[lead]
        if crowded.any():
            many = np.flatnonzero(crowded & first)
            for out, more in zip((buckets, gs, blobs), windows_of(pack, records[many], doc[many], local[many], g), strict=True):
                out += more
        leads = np.flatnonzero((lead == np.arange(len(lead))) & ~crowded)
        twins = np.flatnonzero((lead != np.arange(len(lead))) & first & ~crowded)  # same document, same surroundings
        home = codes.home(digits)
        rank = np.empty(len(lead), np.int64)
        for bucket in np.unique(home[leads]):
            mine = leads[home[leads] == bucket]
            rank[mine] = np.arange(len(mine))
            t = twins[home[twins] == bucket]
            buckets.append(int(bucket))
            gs.append(g)
            blobs.append(squeeze(records[mine], ids[mine].astype("<i8"), doc[mine].astype("<i4"), local[mine].astype("<i8"), rank[lead[t]].astype("<i4"), doc[t].astype("<i4"), local[t].astype("<i8")))
        return messages(buckets, gs, blobs)

    def equal_windows(gs: list[int], blobs: list[bytes]) -> pa.Table:
        """The windows of crowds that one bucket has: which of them a smaller id of another pack holds."""
        lots = [spread(b, "u1", "<i8", "<i4", "<i4", "<i8") for b in blobs]
        windows = np.concatenate([x[0] for x in lots]).reshape(-1, threshold)
        held = _held_before(*_same_windows(windows), np.concatenate([x[1] for x in lots]))
        out_g, out_b, at = [], [], 0
        for g, (_, ids, of, doc, start) in zip(gs, lots, strict=True):
            hit = held[at : at + len(ids)][of]
            at += len(ids)
            if hit.any():
                out_g.append(g)
                out_b.append(squeeze(doc[hit].astype("<i4"), start[hit].astype("<i8"), (start[hit] + threshold).astype("<i8")))
        return messages([0] * len(out_g), out_g, out_b)

    def groups(rows: pa.Table) -> pa.Table:
        """The other passes, for the suffixes of one bucket."""
        gs, blobs = rows.column("g").to_pylist(), rows.column("blob").to_pylist()
        bucket = rows.column("bucket")[0].as_py()
        if bucket < 0:
            return messages([0] * len(gs), gs, blobs)
        if bucket >= n_buckets:
            return equal_windows(gs, blobs)
        lots = [spread(b, "u1", "<i8", "<i4", "<i8", "<i4", "<i4", "<i8") for b in blobs]
        sizes = [len(x[1]) for x in lots]
        records = np.concatenate([x[0] for x in lots]).reshape(sum(sizes), -1)
        low, high = _covered(records, np.concatenate([x[1] for x in lots]), threshold, gram)
        out_g, out_b, at = [], [], 0
        for g, size, (_, _, doc, local, of, t_doc, t_local) in zip(gs, sizes, lots, strict=True):
            lo, hi = low[at : at + size], high[at : at + size]
            lo, hi = np.concatenate([lo, lo[of]]), np.concatenate([hi, hi[of]])
            ok = lo <= hi
            a, b = _spans_of(lo[ok], hi[ok], np.concatenate([local, t_local])[ok], threshold)
            at += size
            if len(a):
                out_g.append(g)
                out_b.append(squeeze(np.concatenate([doc, t_doc])[ok].astype("<i4"), a.astype("<i8"), b.astype("<i8")))
        return messages([0] * len(out_g), out_g, out_b)

    result = T.StructType([*T.StructType.fromDDL("id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept_text string").fields, rows.schema["carry"]])
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(rows: pa.Table, hits: pa.Table) -> pa.Table:
        pack = _Pack(rows, threshold, gram, anchored=False)
        lots = [spread(b, "<i4", "<i8", "<i8") for b in hits.column("blob").to_pylist()]
        doc, a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in lots)]) for k in range(3))
        order = np.lexsort((a, doc))
        doc, a, b = doc[order], a[order], b[order]
        where = np.searchsorted(doc, np.arange(len(pack.ids) + 1))
        out: list[list] = [[] for _ in range(6)]
        for i in range(len(pack.ids)):
            text = pack.data[pack.offsets[i] : pack.offsets[i + 1]]
            spans, s, e = [], a[where[i] : where[i + 1]], b[where[i] : where[i + 1]]
            if len(s):
                reach = np.maximum.accumulate(e)
                new = np.flatnonzero(np.concatenate([[True], s[1:] > reach[:-1]]))
                spans = [(int(x), int(y)) for x, y in zip(s[new], reach[np.append(new[1:], len(s)) - 1], strict=True)]
            kept, done = [], 0
            for x, y in spans:
                kept.append(text[done:x].tobytes())
                done = y
            whole = b"".join([*kept, text[done:].tobytes()])
            row = (len(text), len(text) - len(whole), len(spans), hashlib.sha256(whole).hexdigest(), [{"start": x, "end": y} for x, y in spans], whole.decode(errors="ignore") if with_text else None)
            for c, v in zip(out, row, strict=True):
                c.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), kinds, pa.string()]
        cols = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
        return pa.table([pack.rows.column("id"), *cols, pack.rows.column("carry")], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text", "carry"])

    digits = packs.applyInArrow(first_digits, MESSAGE)
    hits = by_pack(digits, n_buckets, "bucket").groupBy("bucket").applyInArrow(repeated, MESSAGE)
    found = packs.cogroup(hits.groupBy("g")).applyInArrow(suffixes, MESSAGE)
    spans = by_pack(found, 2 * n_buckets, "bucket").groupBy("bucket").applyInArrow(groups, MESSAGE)
    return packs.cogroup(spans.groupBy("g")).applyInArrow(cut, result)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: DuckDB, on the hexadecimal digits of the bytes: windows, their least document, runs of hit windows, what is between.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, o, p, substr(h, 2 * p + 1, 100) AS k FROM (SELECT rid, o, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT k, min(o) AS first FROM w GROUP BY k),
t AS (SELECT rid, p FROM w JOIN f USING (k) WHERE first < o),
r AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS run
      FROM (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM t)),
s AS (SELECT rid, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY rid, run),
k AS (SELECT rid, b AS x, lead(a) OVER (PARTITION BY rid ORDER BY a) AS y FROM s UNION ALL SELECT rid, 0, min(a) FROM s GROUP BY rid),
c AS (SELECT rid, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, len(h) // 2) - x)), '' ORDER BY x) AS kept FROM k JOIN d USING (rid) GROUP BY rid),
n AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c USING (rid) LEFT JOIN n USING (rid)"""
