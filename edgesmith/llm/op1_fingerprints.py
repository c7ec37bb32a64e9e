"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's five-word shingles (A-Z as
lower case). Sketches of parts merge into the sketch of the whole, and estimate resemblance,
containment and the number of distinct shingles; below k shingles all three are exact.

Defined results: null and empty texts and texts without words have the empty sketch; two empty
sketches have resemblance 1, an empty and a full one 0. A null ``doc_id`` sorts first. Rows that
share a ``doc_id`` are neighbours in the order of their compressed texts. An empty table gives an
empty result. Other columns, whatever their names, come back in ``row`` or are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import partitions, table

K = 128
_TOP = float(1 << 64)


def sketches(texts: pa.Array, k: int = K, width: int = 5) -> Iterator[np.ndarray]:
    for hashes in kernels.shingle_sets(texts, width):
        yield hashes[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * _TOP / float(sketch[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's k smallest hashes that both sketches hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds too; 1 for an empty a."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merge(a, b, k), k) if len(b) else 0.0
    return min(1.0, both / distinct(a, k))


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8").astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, width: int = 5) -> DataFrame:
    """row (the input's columns) and fingerprint, each text's encoded sketch. No shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode(s) for s in sketches(batch.column(1), k, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["row", "fingerprint"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns)).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(add, T.StructType([rows.schema["row"], T.StructField("fingerprint", T.StringType())]))


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles_estimate double, containment_in_edited double"


_DEALT = "pid int, ord int, doc_id long, z binary"


def _bounds(docs: DataFrame, n: int) -> tuple[list[int], int | None, bool]:
    """At most n - 1 ids that cut the table into even ranges, the smallest id, and whether an id is null."""
    cuts = [i / n for i in range(1, n)] or [0.5]
    row = docs.agg(F.percentile_approx("doc_id", cuts, 20_000).alias("q"), F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("null")).first()
    low = row["low"]
    return sorted({b for b in row["q"] or [] if b > low}), low, bool(row["null"])


def edited_likeness(docs: DataFrame, k: int = K, width: int = 5) -> DataFrame:
    """Fingerprints of each document and of its edited text, in one shuffle of compressed texts.

    The edited text takes its last quarter from the start of the next document by ``doc_id``. Ids
    are cut into ranges at sampled quantiles (four ranges for each shuffle partition, so the
    driver holds that many numbers); the first document of a range is also sent to the range
    before it, so each range finds every neighbour in its own sorted stream.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds, low, null = _bounds(docs, 4 * partitions(docs.sparkSession))
    cuts, last = np.array(bounds, np.int64), len(bounds)
    first = F.col("doc_id").isNull() if null else F.col("doc_id") == F.lit(low)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for batch in batches:
            out: dict[str, list] = {"pid": [], "ord": [], "doc_id": [], "z": []}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                z = pack.compress((text or "").encode())
                pid = 0 if doc_id is None else int(np.searchsorted(cuts, doc_id, "right"))
                homes = [(pid, 0)]
                if pid and doc_id == cuts[pid - 1]:
                    homes.append((pid - 1, 1))
                for p, o in homes:
                    for c, v in zip(out.values(), (p, o, doc_id, z), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["pid"], pa.int32()), pa.array(out["ord"], pa.int32()), pa.array(out["doc_id"], pa.int64()), pa.array(out["z"], pa.binary())], list(out))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple] = []  # rows of this range whose successor is known once another row comes
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = zip(*(part.column(i).to_pylist() for i in range(3)), (unpack.decompress(z).decode() for z in part.column(3).to_pylist()), strict=True)
                held += rows
                yield from finish(held)
                held = held[-1:]

    def finish(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[1] == 0 and a[0] == b[0]]
        if not pairs:
            return
        edited = []
        for (_, _, _, text), (_, _, _, after) in pairs:
            q = len(text) // 4
            edited.append(text[: len(text) - q] + after[:q])
        own = list(sketches(pa.array([r[3] for r in rows], pa.large_string()), k, width))
        at = {id(r): s for r, s in zip(rows, own, strict=True)}
        new = list(sketches(pa.array(edited, pa.large_string()), k, width))
        cols = [
            pa.array([a[2] for a, _ in pairs], pa.int64()),
            pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array([encode(at[id(a)]) for a, _ in pairs]),
            pa.array([encode(s) for s in new]),
            pa.array([resemblance(at[id(a)], s, k) for (a, _), s in zip(pairs, new, strict=True)], pa.float64()),
            pa.array([resemblance(at[id(a)], at[id(b)], k) for a, b in pairs], pa.float64()),
            pa.array([distinct(at[id(a)], k) for a, _ in pairs], pa.float64()),
            pa.array([containment(at[id(a)], s, k) for (a, _), s in zip(pairs, new, strict=True)], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in _SCHEMA.split(", ")])

    dealt = docs.mapInArrow(deal, _DEALT)
    if low is not None or null:
        # the first document of all follows the last: of those with the least id, the one that the walk meets first
        lead = docs.where(first).mapInArrow(deal, _DEALT).where("ord = 0").orderBy("z").limit(1)
        dealt = dealt.unionByName(lead.select(F.lit(last).alias("pid"), F.lit(2).alias("ord"), "doc_id", "z"))
    n = partitions(docs.sparkSession)
    return dealt.repartition(n, "pid").sortWithinPartitions("pid", "ord", "doc_id", "z").mapInArrow(walk, _SCHEMA)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
