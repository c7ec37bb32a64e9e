"""Packing: optimal length buckets, and token-budget batches inside each.

The global histogram of lengths goes through dynamic programming that chooses at most ``n_buckets``
boundaries with the least total padding when each document is padded to its bucket's longest length.
The choice is optimal over all distinct lengths, whatever they are: the histogram has one entry for
each (of documents with T words in all, at most the root of 2 T), and a round of the programme solves
all its subproblems of one depth at once.

A bucket's documents are put in a fixed shuffled order (by a digest of id and text) and cut into batches
of floor(budget / bucket length) documents, at least one: a document over the budget gets a batch of its
own. Ranks come from slices, so no task holds a whole bucket. ``batches`` gathers the documents of each
batch; a batch is bounded by the budget.

Defined results: null and negative lengths count as 0; length 0 is padded like any other. Repeated
rows count each. An empty table gives an empty result. The input's columns come back in ``row``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .op4_tokens import token_counts
from .ranks import running_start, shuffle_key, slice_of, slices_for

BUCKETS = 16
BUDGET = 32_768


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper ends of the buckets that pad least, from ascending distinct lengths and how many documents have each.

    best[j] is the least padding of the first j lengths in so many buckets. Where the last bucket starts only
    grows with j, so a round halves the range of j: all middles of one depth are solved together, each
    between what its neighbours found.
    """
    n = len(lengths)
    if not n:
        return []
    edge = lengths.astype(np.float64)
    c, s = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)]), np.concatenate([[0.0], np.cumsum(lengths.astype(np.float64) * counts)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    choices = []
    for _ in range(min(n_buckets, n)):
        new, pick = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        lo, hi, a, b = (np.array([x]) for x in (1, n, 0, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            last = np.minimum(b, j - 1)
            size = last - a + 1
            first = np.cumsum(size) - size
            i = np.arange(size.sum()) - np.repeat(first - a, size)
            to = np.repeat(j, size)
            cost = best[i] + edge[to - 1] * (c[to] - c[i]) - (s[to] - s[i])
            least = np.minimum.reduceat(cost, first)
            at = np.flatnonzero(cost == np.repeat(least, size))
            at = at[np.searchsorted(at, first)]  # the first of equals
            new[j], pick[j] = least, i[at]
            lo, hi, a, b = np.concatenate([lo, j + 1]), np.concatenate([j - 1, hi]), np.concatenate([a, i[at]]), np.concatenate([i[at], b])
            live = lo <= hi
            lo, hi, a, b = lo[live], hi[live], a[live], b[live]
        choices.append(pick)
        best = new
    out, j = [], n
    for pick in reversed(choices):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(pick[j])
    return sorted(out)


def histogram(lengths: DataFrame, column: str = "length") -> tuple[np.ndarray, np.ndarray]:
    """Distinct lengths, ascending, and how many documents have each."""
    rows = lengths.groupBy(F.col(column).alias("length")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    order = np.argsort(rows.column("length").to_numpy())
    return rows.column("length").to_numpy()[order], rows.column("n").to_numpy()[order]


def pack(docs: DataFrame, length: Column, key: Column | None = None, n_buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """row, length, bucket (0 for the shortest), bucket_length, batch (from 0 in each bucket), slot
    (from 0 in each batch) and padding, for every input row."""
    key = shuffle_key(F.col("doc_id"), F.col("text")) if key is None else key
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns))
    d = materialise(docs.select(row.alias("row"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("length"), key.alias("key")))
    lengths, counts = histogram(d)
    edges = optimal_boundaries(lengths, counts, n_buckets) or [0]
    ends = F.array(*[F.lit(e).cast("long") for e in edges])
    bucket = F.size(F.filter(ends, lambda e: e < F.col("length"))).cast("long")
    placed = d.withColumn("bucket", bucket).withColumn("bucket_length", F.element_at(ends, (F.col("bucket") + 1).cast("int"))).withColumn("slice", slice_of(F.col("key"), slices_for(int(counts.sum()))))
    ranked = running_start(placed, ["bucket"], "slice", ["key", "length"], F.lit(1).cast("long"), "rank")
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))), F.lit(1)).cast("long")
    return ranked.select("row", "length", "bucket", "bucket_length", F.floor(F.col("rank") / room).cast("long").alias("batch"), F.pmod(F.col("rank"), room).cast("long").alias("slot"), (F.col("bucket_length") - F.col("length")).alias("padding"))


def batches(packed: DataFrame, *columns: str) -> DataFrame:
    """bucket, batch, bucket_length, n_docs, padding and ``docs``, the named columns of the rows with their lengths in the
    order of their slots: one row a batch, bounded by the budget (or one document)."""
    doc = F.struct("slot", "length", *[F.col(f"row.`{c}`").alias(c) for c in columns])
    got = packed.groupBy("bucket", "batch", "bucket_length").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("padding").alias("padding"), F.sort_array(F.collect_list(doc)).alias("docs"))
    return got.select("bucket", "batch", "bucket_length", "n_docs", "padding", F.transform("docs", lambda x: x.dropFields("slot")).alias("docs"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are token counts of whole texts."""
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", "text", shuffle_key(F.col("doc_id"), F.col("text")).alias("key"))
    sized = token_counts(keyed, keep=["doc_id", "key"]).select("row.doc_id", "n_tokens", "row.key")
    return pack(sized, F.col("n_tokens"), F.col("key")).select("row.doc_id", "length", "bucket", "bucket_length", "batch", "slot", "padding")
