"""Host-level quality rules, in DataFrame functions only.

Each document is measured and failed by base rules of its own. Failures are summed by host (for
``documents``, the ``source``); each host's failure rate is shrunk towards the others' by a beta
prior fitted to the hosts' rates by moments; a host whose shrunk rate exceeds the limit is rejected,
and the verdict is joined back to its documents. A host with more than its share of all documents, the total over
four places a shuffle partition, gets as many salts as shares, and its verdict a row for each salt; all other
hosts have one. So a host with a third of all is dealt over a third of the places, however many rows that is. The hosts
with salts are fewer than the places, so that they can be broadcast.

The prior: with m the mean and v the variance of the rates of hosts with documents, the strength is
m(1-m)/v - 1, held between 1 and 1e6 (v = 0 gives 1e6), alpha = m * strength and beta = (1-m) *
strength. The shrunk rate is (failures + alpha) / (documents + alpha + beta).

Defined results: null and empty texts have no words and fail. A null host is a host of its own.
Repeated rows count each. An empty table gives an empty result. Only the named columns are read;
all others come back as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialise, salted, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def _held(value: Column, use) -> Column:
    """use(value), with value computed once (a lambda's variable isn't inlined)."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows whose words occur as a window twice or more.

    Windows are sorted by their hash within the row, O(n log n); most texts have none that repeat
    and stop at the distinct count.
    """
    windows = F.when(F.size(words) >= 3, F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - s, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, j: (x["h"] == F.get(ordered, j + 1)["h"]) | ((j > 0) & (x["h"] == F.get(ordered, F.greatest(j - 1, F.lit(0)))["h"])))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return _held(starts, covered)

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # a null neighbour (past the end) makes the comparison null, which filter takes as false
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_held(ordered, repeated))

    return _held(windows, count)


def measures(text: Column) -> Column:
    """Struct of the base measures of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    return _held(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            _held(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )


def host_rates(judged: DataFrame, host: str, failed: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, rejected: one row per host."""
    hosts = judged.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    # two numbers reach the driver and go back as literals, so nothing is joined crosswise
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    mean, spread = moments["m"] or 0.0, moments["v"] or 0.0
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    alpha, beta = mean * strength, (1 - mean) * strength
    shrunk = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    return hosts.select(host, "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk > max_rate).alias("rejected"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", carry: list[str] | None = None, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``carry`` columns (all by default) with the measures, base_failed, shrunk_rate and kept.

    The input's columns come back in the struct ``row``, so that none clashes with a measure.
    """
    names = docs.columns if carry is None else carry
    m = docs.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in names)).alias("row"), F.col(f"`{host}`").cast("string").alias("host"), measures(F.col(f"`{text}`")).alias("m"))
    failed = (F.col("m.n_words") < min_words) | (100 * F.col("m.n_repeat_words") > max_repeat_percent * F.col("m.n_words"))
    judged = materialise(m.select("row", "host", F.monotonically_increasing_id().alias("at"), "m.*", failed.alias("base_failed")))
    rates = materialise(host_rates(judged, "host", "base_failed", max_host_rate))
    dealt, salts = salted(judged, "host", F.col("at"), rates.select("host", F.col("n_docs").alias("n")))
    verdicts = rates.join(salts, F.col("host").eqNullSafe(F.col("_key"))).select(F.col("host").alias("verdict_host"), "shrunk_rate", "rejected", "_salt")
    # not broadcast by hand: hosts grow with the crawl. The null-safe join also finds the null host.
    joined = dealt.join(verdicts, (F.col("salt") == F.col("_salt")) & F.col("host").eqNullSafe(F.col("verdict_host")), "left")
    return joined.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "shrunk_rate", (~F.col("base_failed") & ~F.col("rejected")).alias("kept"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: DuckDB, with one placeholder for the documents.
VERDICT_SQL = r"""
t AS (SELECT *, coalesce(text, '') AS x FROM {docs}),
w AS (SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS words,
             list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines,
             row_number() OVER () AS rid FROM t),
g AS (SELECT rid, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS k
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
d AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY rid),
m AS (SELECT w.* EXCLUDE (words, lines), len(words)::BIGINT AS n_words,
             length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
h AS (SELECT source AS host, count(*) AS nd, sum(base_failed::INT) AS nf FROM b GROUP BY source),
q AS (SELECT avg(nf / nd) AS mu, coalesce(var_pop(nf / nd), 0) AS va FROM h),
s AS (SELECT mu, CASE WHEN va > 0 THEN least(greatest(mu * (1 - mu) / va - 1, 1.0), 1e6) ELSE 1e6 END AS st FROM q),
v AS (SELECT host, (nf + mu * st) / (nd + st) > 0.5 AS rejected FROM h, s),
judged AS (SELECT b.*, (NOT base_failed AND NOT rejected) AS kept FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.host)"""

SQL = f"WITH {VERDICT_SQL.format(docs='documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
