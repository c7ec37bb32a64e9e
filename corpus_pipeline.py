"""A training corpus from ``documents``: quality, near duplicates, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the
checkpoint folder and gives what it reads back to the next. All but the last return the columns of
``documents``, whatever their names. Null texts are empty, null ids and sources are values like others, repeated
rows are documents each (near duplicates keep one), ties go to the least (id, text hash); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgesmith.llm.common import materialise, table
from edgesmith.llm.op2_suffix_dedup import removed_passages
from edgesmith.llm.op3_quality import judge
from edgesmith.llm.op4_tokens import token_counts
from edgesmith.llm.op5_packing import pack
from edgesmith.llm.op6_mixing import copies
from edgesmith.llm.op10_jaccard_join import near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules, on hosts that pass. A null text fails; a null source is a host."""
    return judge(docs).where("kept").select("row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least (doc_id, text hash). Of repeated rows one stays;
    documents without words are groups of their own."""
    found = near_duplicates(docs).select("id", "text_hash", "component")
    # documents without partners form groups of their own
    group = F.struct("component", F.when(F.col("component").isNull(), F.struct("id", "text_hash")))
    first = found.groupBy(group.alias("group")).agg(F.min(F.struct("id", "text_hash")).alias("first"))
    keep = first.select(F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns)).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    one = rows.join(keep, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_semi")
    return one.select("row", F.col("row.doc_id").alias("doc_id"), "hash").dropDuplicates(["doc_id", "hash"]).select("row.*")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents of smaller ids hold; n_chars follows. A null text becomes empty; a null
    id comes after all others."""
    out = removed_passages(docs)
    made = {"doc_id": F.col("id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return out.select(*[made.get(c, F.col(f"carry.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, one row a copy; the last copy of a source's share is cut to the
    words taken, joined by spaces. Documents that the mix does not take, and those without words, go."""
    words = F.filter(F.split("row.text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    cut = F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")
    out = copies(docs).select("row", F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(cut).alias("text"))
    made = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*[made.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their length in tokens, their length bucket and their place in a batch. Null texts have length 0."""
    counted = token_counts(docs, keep=["doc_id", "source", "text"]).select("row.*", "n_tokens")
    return pack(counted, F.col("n_tokens")).select("row.doc_id", "row.source", "row.text", "length", "bucket", "bucket_length", "batch", "slot", "padding")


STAGES = [("quality", quality), ("near duplicates", near_duplicate), ("passages", passages), ("mixture", mixture), ("packing", packing)]

#: Suffix passes and the choice of buckets are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
