"""URL filters: a temporal join of captures with dated list entries.

Dated entries (list, pattern, day, action) become validity intervals: an ``add`` holds from its day to
the day before the next entry for the same list and pattern; where a pattern has both actions on one
day, the removal counts. A capture looks up its host, each parent domain, each of these with every
prefix of its path by parts and with its whole path and query, and its url, and is judged by the entries active on the day it was fetched (an as-of join:
equality on the key, and the interval around the day; at most one entry a list and pattern).

Each distinct (url, day) is judged once and the verdict joined back, so repeated captures of one page
don't multiply. Most keys are in no list, and some (a domain ending) are those of a third of all captures.
Up to ``BROADCAST`` intervals, counted, every task has them all, and no key is shuffled. Beyond, keys are
counted and dealt by (key, salt), as many salts as the key has shares of all, and each interval goes to every salt of its key.

Defined results: a null or unparsable url, or a null day, matches nothing. Null patterns, days or lists
are no entries. Repeated entries count once. With no entries all captures pass. The input's columns come back
in the struct ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, salted, table

#: Most intervals (some hundred bytes each) that are broadcast.
BROADCAST = 200_000


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, since, until (null: still valid) from (list, pattern, day, action) rows."""
    e = entries.where("list is not null and pattern is not null and day is not null and action in ('add', 'remove')")
    e = e.groupBy("list", F.lower("pattern").alias("pattern"), "day").agg(F.max("action").alias("action"))
    after = Window.partitionBy("list", "pattern").orderBy("day")
    return e.withColumn("until", F.lead("day").over(after)).where("action = 'add'").select("list", "pattern", F.col("day").alias("since"), "until")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def lookup_keys(url: Column) -> Column:
    """Host, parent domains, each with every prefix of the path by parts, and with path and query whole, and the
    url itself; none without a host."""
    host, text = host_of(url), F.lower(F.coalesce(url, F.lit("")))
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    path = F.regexp_extract(text, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    steps = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    whole = F.regexp_extract(text, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^#]*)", 1)
    tails = F.filter(F.array_distinct(F.concat(prefixes, F.array(whole))), lambda t: t != "")
    paths = F.flatten(F.transform(domains, lambda d: F.transform(tails, lambda t: F.concat(d, F.lit("/"), t))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, paths, F.array(text))))


def _meeting(looked: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """looked (url, day, pattern) joined with the intervals of its patterns."""
    held = materialise(held)
    if held.count() <= most:
        return looked.join(F.broadcast(held), "pattern")
    counts = materialise(looked.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).join(held, "pattern", "left_semi"))
    dealt, salts = salted(looked, "pattern", F.xxhash64("url", "day"), counts)
    every = held.join(salts, F.col("pattern") == F.col("_key")).select("*", F.col("_salt").alias("salt")).drop("_key", "_salt")
    return dealt.join(every, ["pattern", "salt"])


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched", broadcast: int = BROADCAST) -> DataFrame:
    """row, host, n_active (entries), lists (names, ascending, comma between), pattern (the longest, then
    first) and blocked, for every capture."""
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in captures.columns))
    c = captures.select(row.alias("row"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{day}`").cast("date").alias("day"))
    looked = c.select("url", "day").distinct().select("url", "day", F.explode(lookup_keys(F.col("url"))).alias("pattern"))
    active = _meeting(looked, intervals(entries), broadcast).where((F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    found = active.groupBy("url", "day").agg(
        F.count(F.lit(1)).alias("n_active"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
        F.min(F.struct(-F.length("pattern"), F.col("pattern").alias("p")))["p"].alias("pattern"),
    )
    found = found.select(F.col("url").alias("u"), F.col("day").alias("d"), "n_active", "lists", "pattern")
    out = c.join(found, (F.col("url") == F.col("u")) & (F.col("day") == F.col("d")), "left")
    return out.select("row", host_of(F.col("url")).alias("host"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "lists", "pattern", F.col("n_active").isNotNull().alias("blocked"))


def made_entries(pages: DataFrame) -> DataFrame:
    """The tables hold no filter lists, so the query makes them from the hosts: list, pattern, day, action.

    By the digest of its name a host is added to a list on a day of the first year and removed again on a
    later day; the parent domain of some hosts is on a second list from a day of the second year on.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    digit = lambda at: F.conv(F.substring(F.md5("host"), at, 4), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    h = hosts.select("host", digit(1).alias("a"), digit(5).alias("b"), digit(9).alias("c"))
    add = h.where("a % 3 = 0").select(F.lit("spam").alias("list"), F.col("host").alias("pattern"), day(F.col("b") % 365).alias("day"), F.lit("add").alias("action"))
    drop = h.where("a % 3 = 0").select(F.lit("spam").alias("list"), F.col("host").alias("pattern"), day(F.col("b") % 365 + 1 + F.col("c") % 300).alias("day"), F.lit("remove").alias("action"))
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    wide = h.where("c % 5 = 0").select(F.lit("malware").alias("list"), parent.alias("pattern"), day(365 + F.col("b") % 365).alias("day"), F.lit("add").alias("action"))
    path = h.where("b % 4 = 0").select(F.lit("adult").alias("list"), F.concat("host", F.lit("/en")).alias("pattern"), day(F.col("c") % 730).alias("day"), F.lit("add").alias("action"))
    return add.unionByName(drop).unionByName(wide).unionByName(path)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod(F.col("page_id") * 37, F.lit(730))).cast("int")))
    out = judge(captures, made_entries(pages))
    return out.select("row.page_id", "row.url", F.date_format("row.fetched", "yyyy-MM-dd").alias("fetched"), "host", "n_active", "lists", "pattern", "blocked")


SQL = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 730)::INT AS day,
                  lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
                  lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1)) AS first FROM pages),
h AS (SELECT host, ('0x' || substr(md5(host), 1, 4))::INT AS a, ('0x' || substr(md5(host), 5, 4))::INT AS b, ('0x' || substr(md5(host), 9, 4))::INT AS c
      FROM (SELECT DISTINCT host FROM c WHERE host <> '')),
e AS (SELECT 'spam' AS list, host AS pattern, DATE '2024-01-01' + (b % 365) AS day, 'add' AS action FROM h WHERE a % 3 = 0
      UNION ALL SELECT 'spam', host, DATE '2024-01-01' + (b % 365 + 1 + c % 300), 'remove' FROM h WHERE a % 3 = 0
      UNION ALL SELECT 'malware', regexp_replace(host, '^[^.]*\.', ''), DATE '2024-01-01' + (365 + b % 365), 'add' FROM h WHERE c % 5 = 0
      UNION ALL SELECT 'adult', host || '/en', DATE '2024-01-01' + (c % 730), 'add' FROM h WHERE b % 4 = 0),
d AS (SELECT list, pattern, day, max(action) AS action FROM e GROUP BY ALL),
i AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM d) WHERE action = 'add'),
m AS (SELECT c.page_id, i.list, i.pattern FROM c JOIN i
      ON (c.host = i.pattern OR ends_with(c.host, '.' || i.pattern) OR (c.first <> '' AND (c.host || '/' || c.first = i.pattern OR ends_with(c.host || '/' || c.first, '.' || i.pattern))))
      AND c.day >= i.day AND (i.until IS NULL OR c.day < i.until)),
g AS (SELECT page_id, count(*) AS n_active, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists, first(pattern ORDER BY length(pattern) DESC, pattern) AS pattern FROM m GROUP BY page_id)
SELECT c.page_id, c.url, strftime(c.day, '%Y-%m-%d') AS fetched, c.host, coalesce(n_active, 0)::BIGINT AS n_active, lists, pattern, n_active IS NOT NULL AS blocked
FROM c LEFT JOIN g USING (page_id)"""
