"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share the words of
all; no target exceeds ``cap`` times its source's words, and what is over is shared anew by weight
among the others, round by round: each round is one sum over the sources, and two numbers reach the
driver. Sources are numbered by a range sort, so no task holds them all.

Schedule: slot i holds the golden-ratio point frac(i * phi), in 31-bit integers; cumulative targets
map it to a source, and its rank among that source's slots names the block of ``block`` words that it
takes from the source's endless stream: the documents in a fixed shuffled order (by a digest of id and
text, so that rows with one id are spread), again and again. The
last block of a source is cut so that exactly round(target) words are taken; slots past a source's
last block fall out, and the few that the points leave over close the schedule. Ranks come from chunks
of consecutive slots, so no task ranks a whole source. ``copies`` gives each copy of a document the slot
at which it starts: the order in which to emit them.

Defined results: null and empty texts have size 0 and are never taken. A source without words has
target 0. Repeated rows count each. An empty table gives an empty result. The input's columns come
back in the struct ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgesmith.functions.lineage import row_numbers

from .common import WORD, materialise, table
from .ranks import running_start, shuffle_key, slice_of, slices_for

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 256
_RING = 1 << 31
_STEP = 1_327_217_885  # the nearest odd integer to 2**31 over the golden ratio
_CHUNK = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (source, size) rows: source, sid, source_size, target, quota, one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = row_numbers(per, F.col("source").asc_nulls_last()).withColumnRenamed("rn", "sid")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int") + 1).cast("double"))
    most = cap * F.col("source_size")
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight, full = total or 0, weight or 0.0, 0.0
    level = total / weight if weight else 0.0
    while True:  # the level rises, and with it the sources that it fills
        held, now = ranked.where(most <= F.col("weight") * F.lit(level)).agg(F.sum(most), F.sum("weight")).first()
        if (now or 0.0) == full or now == weight:
            break
        level, full = (total - held) / (weight - now), now
    target = F.when(most <= F.col("weight") * F.lit(level), most.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target).select("source", "sid", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota"))


def _slots(spark: SparkSession, sources: DataFrame, block: int) -> DataFrame:
    """slot, sid, rank: which block of which source each slot takes."""
    quotas = sources.where("quota > 0").select("sid", "quota", F.ceil(F.col("quota") / block).cast("long").alias("blocks"), F.floor(F.col("sid") / _CHUNK).alias("part"))
    total = quotas.agg(F.sum("quota")).first()[0] or 1
    begins = running_start(quotas, [], "part", ["sid"], F.col("quota"), "begin")
    place = lambda c: F.floor(c.cast("double") / F.lit(float(total)) * _RING).cast("long")
    arcs = materialise(begins.select("sid", "blocks", place(F.col("begin")).alias("lo"), place(F.col("begin") + F.col("quota")).alias("hi")))
    stats = arcs.agg(F.sum("blocks").alias("n"), F.count(F.lit(1)).alias("sources"), F.min(F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))).alias("arc")).first()
    n = stats["n"] or 0
    n_slots = n + min((4 * (n + 2).bit_length() + 8) * (_RING // (stats["arc"] or _RING) + 1), n + 1024)
    # cells for the join of points and arcs: some for each source
    cell = _RING >> min(24, max(12, (4 * stats["sources"]).bit_length()))
    by_cell = arcs.where("hi > lo").select("sid", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("cell"))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(_RING)) * _STEP, F.lit(_RING)).alias("u")).withColumn("cell", F.floor(F.col("u") / cell))
    hits = points.join(by_cell, "cell").where("u >= lo and u < hi").select("slot", "sid", "blocks", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    ranked = running_start(hits, ["sid"], "chunk", ["slot"], F.lit(1).cast("long"), "rank").where("rank < blocks").select("slot", "sid", "rank")
    had = hits.groupBy("sid").agg(F.count(F.lit(1)).alias("had"))
    rest = arcs.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < blocks")
    closing = rest.select("sid", F.explode(F.sequence(F.col("had"), F.col("blocks") - 1)).alias("rank"))
    return ranked.unionByName(closing.select((F.lit(n_slots) + F.col("rank")).alias("slot"), "sid", "rank"))


def _sized(docs: DataFrame, source: str, size: Column, key: Column, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, DataFrame]:
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns))
    d = materialise(docs.select(row.alias("row"), F.col(f"`{source}`").cast("string").alias("source"), size.cast("long").alias("size"), key.alias("key")))
    sources = materialise(targets(d, weights, cap))
    n_slices = slices_for(d.count())
    joined = d.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source").withColumn("slice", slice_of(F.col("key"), n_slices))
    placed = running_start(joined, ["sid"], "slice", ["key", "size"], F.col("size"), "start")
    return materialise(placed.drop("key", "slice")), sources


def schedule(docs: DataFrame, source: str = "source", text: str = "text", key: Column | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, size: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix and the documents it is made of.

    First: slot, sid, start (the document's place in its source's stream), copy (0 for the first time
    through), first_word and words: in slot order, what to emit. Second: row, sid, size, source_size,
    target, quota, start.
    """
    size = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)) if size is None else size
    key = shuffle_key(F.col("doc_id"), F.col(f"`{text}`")) if key is None else key
    placed, sources = _sized(docs, source, size, key, weights, cap)
    slots = _slots(docs.sparkSession, sources, block)
    copies = placed.where("size > 0").select("sid", "start", "size", "quota", "source_size", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("copy"))
    copies = copies.withColumn("begin", F.col("start") + F.col("copy") * F.col("source_size")).withColumn("stop", F.least(F.col("begin") + F.col("size"), F.col("quota"))).where("begin < stop")
    pieces = copies.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("stop") - 1) / block))))
    lo, hi = F.greatest(F.col("begin"), F.col("rank") * block), F.least(F.col("stop"), (F.col("rank") + 1) * block)
    pieces = pieces.select("sid", "rank", "start", "copy", (lo - F.col("begin")).alias("first_word"), (hi - lo).alias("words"))
    return slots.join(pieces, ["sid", "rank"]).select("slot", "sid", "start", "copy", "first_word", "words"), placed


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: Column | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, size: Column | None = None) -> DataFrame:
    """row, size, source_size, target, taken (words) and first_slot (null: none) for every input row."""
    plan, placed = schedule(docs, source, text, key, weights, cap, block, size)
    taken = plan.groupBy("sid", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return _matched(placed, taken).select("row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def _matched(placed: DataFrame, plan: DataFrame, how: str = "left") -> DataFrame:
    # rows of size 0 share their start with the next document, so they don't look for words
    p = placed.withColumn("at", F.when(F.col("size") > 0, F.col("start"))).alias("p")
    return p.join(plan.alias("t"), (F.col("p.sid") == F.col("t.sid")) & (F.col("p.at") == F.col("t.start")), how)


def copies(docs: DataFrame, source: str = "source", text: str = "text", key: Column | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, size: Column | None = None) -> DataFrame:
    """row, size, copy, words and slot for every copy that the mix takes: the first ``words`` words, to be emitted in the
    order of ``slot``, which is that of the copy's first block."""
    plan, placed = schedule(docs, source, text, key, weights, cap, block, size)
    each = plan.groupBy("sid", "start", "copy").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    return _matched(placed, each, "inner").select("row", "size", "copy", "words", "slot")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("words"), shuffle_key(F.col("doc_id"), F.col("text")).alias("key"))
    out = mix(sized, size=F.col("words"), key=F.col("key"))
    return out.select("row.doc_id", "size", "source_size", "target", "taken", F.coalesce("first_slot", F.lit(-1)).cast("long").alias("first_slot"))


#: DuckDB: targets by running sums over the sources in the order in which they fill; the schedule slot by slot.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS key, row_number() OVER () AS rid FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((sid - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
c AS (SELECT *, 3 * source_size <= weight * level AS capped FROM l),
t AS (SELECT source, sid, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE weight * max(level) FILTER (WHERE NOT capped) OVER () END AS target FROM c),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t),
a AS MATERIALIZED (SELECT sid, (quota + 255) // 256 AS blocks, floor((sum(quota) OVER (ORDER BY sid) - quota)::DOUBLE / (sum(quota) OVER ())::DOUBLE * 2147483648)::BIGINT AS lo,
             floor((sum(quota) OVER (ORDER BY sid))::DOUBLE / (sum(quota) OVER ())::DOUBLE * 2147483648)::BIGINT AS hi FROM q WHERE quota > 0),
z AS (SELECT n, n + least((4 * length(bin(n + 2)) + 8) * (2147483648 // arc + 1), n + 1024) AS n_slots
      FROM (SELECT coalesce(sum(blocks), 0)::BIGINT AS n, coalesce(min(hi - lo) FILTER (hi > lo), 2147483648)::BIGINT AS arc FROM a)),
u AS (SELECT slot, (slot % 2147483648 * 1327217885) % 2147483648 AS u FROM (SELECT unnest(range(n_slots)) AS slot FROM z)),
h AS MATERIALIZED (SELECT slot, sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM u JOIN a ON u >= lo AND u < hi),
g AS (SELECT a.sid, a.blocks, count(h.slot) AS had FROM a LEFT JOIN h USING (sid) GROUP BY ALL),
e AS (SELECT slot, sid, rank FROM h WHERE rank < blocks UNION ALL SELECT n_slots + rank, sid, rank FROM (SELECT sid, unnest(range(had, blocks)) AS rank FROM g WHERE had < blocks), z),
p AS (SELECT d.rid, d.doc_id, d.size, q.sid, q.source_size, q.target, q.quota, (sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT rid, sid, start + i * source_size AS begin, least(start + i * source_size + size, quota) AS stop FROM p, range(3) r(i) WHERE size > 0),
f AS (SELECT rid, min(slot) AS first_slot FROM (SELECT rid, sid, unnest(range(begin // 256, (stop - 1) // 256 + 1)) AS rank FROM k WHERE begin < stop) JOIN e USING (sid, rank) GROUP BY rid),
o AS (SELECT rid, sum(stop - begin)::BIGINT AS taken FROM k WHERE begin < stop GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(first_slot, -1)::BIGINT AS first_slot FROM p LEFT JOIN o USING (rid) LEFT JOIN f USING (rid)"""
