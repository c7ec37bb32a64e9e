"""Packs: groups of documents of bounded bytes whose keys meet in buckets as compressed blobs.

A message row is (bucket, g, blob): what pack ``g`` tells a bucket, or a bucket tells pack ``g``.
One row a pack and bucket replaces one row a key, and keys are combined before they are sent.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
MESSAGE = "bucket long, g long, blob binary"


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of any types in one compressed blob."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8")
    return zstandard.ZstdCompressor(1).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def spread(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def messages(buckets: list[int], gs: list[int], blobs: list[bytes]) -> pa.Table:
    return pa.table([pa.array(buckets, pa.int64()), pa.array(gs, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "g", "blob"])


class Digits:
    """The leading bytes of 64-bit hashes: enough that chance repeats stay below one in 2**14."""

    def __init__(self, n_keys: int, n_buckets: int):
        self.width = 6 if math.log2(n_keys + 2) + 14 <= 48 else 8
        self.n_buckets = n_buckets

    def short(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> U(64 - 8 * self.width)

    def to_bytes(self, digits: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(digits.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width])

    def from_bytes(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros((len(raw) // self.width, 8), np.uint8)
        out[:, : self.width] = raw.reshape(-1, self.width)
        return out.view("<u8").ravel().astype(U)

    def home(self, digits: np.ndarray) -> np.ndarray:
        return (digits % U(self.n_buckets)).astype(np.int64)

    def deal(self, g: int, digits: np.ndarray) -> pa.Table:
        """Distinct ascending digits of a pack, to their buckets."""
        home = self.home(digits)
        order = np.argsort(home, kind="stable")
        keys, where = np.unique(home[order], return_index=True)
        parts = np.split(digits[order], where[1:]) if len(keys) else []
        return messages(keys.tolist(), [g] * len(keys), [squeeze(self.to_bytes(p)) for p in parts])

    def repeated(self, rows: pa.Table) -> pa.Table:
        """In a bucket: tell each pack which of its digits another pack has too."""
        gs = rows.column("g").to_pylist()
        lists = [self.from_bytes(spread(b, "u1")[0]) for b in rows.column("blob").to_pylist()]
        every = np.sort(np.concatenate(lists))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out_g, out_b = [], []
        for g, digits in zip(gs, lists, strict=True):
            if len(keep := digits[np.isin(digits, twice, assume_unique=True)]):
                out_g.append(g)
                out_b.append(squeeze(self.to_bytes(keep)))
        return messages([0] * len(out_g), out_g, out_b)

    def told(self, rows: pa.Table) -> np.ndarray:
        """All digits that buckets told a pack, ascending."""
        return np.unique(np.concatenate([np.zeros(0, U), *(self.from_bytes(spread(b, "u1")[0]) for b in rows.column("blob").to_pylist())]))
