"""Vectorised byte kernels: words, shingle hashes and sliding minima over Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on a copy."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind, count=n + 1, offset=texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes, so that temporaries stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (n + 1 entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """For each position the number that its next eight bytes make (zeros beyond the end); no copy is made."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


#: Keeps the low n bytes of eight.
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], U)
_SEED = U(0x8F1BBCDC5A827999)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.uint64 = _SEED) -> np.ndarray:
    """64-bit hash of data[s:e] for each span: equal bytes have equal hashes wherever they stand.

    Eight bytes at a time go through a mixing permutation together with the hash so far, so spans of one length
    up to eight never collide and longer ones have no algebraic structure (a polynomial would) to collide by.
    """
    size = ends - starts
    out = mix(size.astype(U) ^ seed)
    if not len(out):
        return out
    words = eights(data)
    live, at, left = None, starts, size
    while True:
        took = words[at].astype(U) & _LOW[np.minimum(left, 8)]
        now = mix((out if live is None else out[live]) ^ took) + seed
        if live is None:
            out = now
        else:
            out[live] = now
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """span_hashes of all windows of ``width`` bytes, in order."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    words, out = eights(data), np.full(n, mix(np.array([width], U) ^ _SEED)[0])
    for k in range(0, width, 8):
        out = mix(out ^ (words[k : k + n] & _LOW[min(8, width - k)])) + _SEED
    return out


_COEFFICIENTS = mix(np.arange(1, 65, dtype=U)) | U(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = 5, seed: np.uint64 = _SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``width``-word shingles (with repeats) and their offsets by text.

    A text with fewer words gives one hash of its whole sequence; one without words gives none.
    Letters A-Z count as lower case.
    """
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends, seed) if len(starts) else np.zeros(0, U)
    counts = np.diff(first)
    out = np.zeros(max(0, len(words) - width + 1), U)
    for j in range(width):
        out += words[j : j + len(out)] * _COEFFICIENTS[j]
    out = mix(out)
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    ofs = np.concatenate([[0], np.cumsum(many)])
    if not ofs[-1]:
        return np.zeros(0, U), ofs
    at = np.repeat(first[:-1] - ofs[:-1], many) + np.arange(ofs[-1])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(out):
        result = out[np.minimum(at, len(out) - 1)]
    else:
        result = np.zeros(ofs[-1], U)
    for i in short:
        w = words[first[i] : first[i + 1]]
        result[ofs[i]] = mix((w * _COEFFICIENTS[: len(w)]).sum(dtype=U, keepdims=True) + U(len(w)))[0]
    return result, ofs


#: For a second, independent family of hashes.
OTHER = U(0x5A0F3C9B71D2E486)


def shingle_sets(texts: pa.Array, width: int = 5, seed: np.uint64 = _SEED) -> Iterator[np.ndarray]:
    """For each text, in order, its distinct shingle hashes, ascending."""
    data, offsets = buffers(texts)
    for i, j in chunks(offsets):
        part = offsets[i : j + 1]
        hashes, ofs = shingle_hashes(data[part[0] : part[-1]], part - part[0], width, seed)
        for a, b in zip(ofs[:-1], ofs[1:], strict=True):
            yield np.unique(hashes[a:b])


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """best over values[i : i + width] for each i with a whole window."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, now = 1, values
    while have * 2 <= width:
        now = best(now[:-have], now[have:])
        have *= 2
    return best(now[:n], now[width - have : width - have + n]) if have < width else now[:n]
