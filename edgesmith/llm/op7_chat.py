"""Chat formatting: one rendering of a dialogue for each of its participants.

In the view of a participant their turns are the assistant's, all other speakers are users under
their own names, and turns of ``system_roles`` stay system turns. A rendering is kept as one row a turn:
the turn's segment, where it starts and ends in the rendered dialogue (in characters), and the part of it
that the loss counts (``mask_start`` to ``mask_end``: an assistant turn's words and end mark; -1 for
other turns). ``dialogues`` joins the segments of views short enough for one value.

A segment is ``<|im_start|>ROLE[ name=SPEAKER]`` newline, the text, ``<|im_end|>`` newline. So that no text or
name can forge a mark, a turn or a mask, every ``<|`` in them becomes ``< |``, and line feeds in names spaces.

Turns of a conversation are ordered by (turn, role, text). A range sort over all turns cuts them into parts,
whatever their numbers; offsets are running sums inside a part plus the parts' starts. So a conversation
with a third of all turns is spread over a third of all parts, also if its turns share one number or have none.

Defined results: a null text is empty, a null role is the speaker ``unknown``, a null turn counts as -1,
null ids form one conversation. A conversation of system turns only has no participants, so no view.
Repeated turns are rendered each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .ranks import running_start

START, END = "<|im_start|>", "<|im_end|>\n"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _header(role: Column, name: Column) -> Column:
    return F.concat(F.lit(START), role, F.when(role == "user", F.concat(F.lit(" name="), F.translate(_safe(name), "\n", " "))).otherwise(F.lit("")), F.lit("\n"))


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, segment, seg_start, seg_end, mask_start, mask_end."""
    t = turns.select(
        F.col(f"`{conv}`").cast("string").alias("key"), F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("unknown")).alias("speaker"), _safe(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("text"),
    )
    t = t.withColumn("key", F.when(F.col("key").isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), "key")))
    people = t.where(~F.col("speaker").isin(*system_roles)).select("key", F.col("speaker").alias("perspective")).distinct()
    shown = F.when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).when(F.col("speaker").isin(*system_roles), F.lit("system")).otherwise(F.lit("user"))
    views = t.join(people, "key").withColumn("role", shown).withColumn("header", _header(F.col("role"), F.col("speaker")))
    views = views.withColumn("n", (F.length("header") + F.length("text") + len(END)).cast("long")).withColumn("tie", F.monotonically_increasing_id())
    # written before and after the sort: neither the ties nor the parts change once seen
    order = [F.coalesce("turn", F.lit(-1)), "speaker", "text", "tie"]
    views = materialise(views)
    views = materialise(views.repartitionByRange("key", "perspective", *order).withColumn("part", F.spark_partition_id()))
    placed = running_start(views, ["key", "perspective"], "part", order, F.col("n"), "seg_start")
    mine = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "role", F.concat("header", "text", F.lit(END)).alias("segment"), "seg_start", (F.col("seg_start") + F.col("n")).alias("seg_end"),
        F.when(mine, F.col("seg_start") + F.length("header")).otherwise(F.lit(-1)).cast("long").alias("mask_start"),
        F.when(mine, F.col("seg_start") + F.col("n") - 1).otherwise(F.lit(-1)).cast("long").alias("mask_end"),
    )


def dialogues(views: DataFrame) -> DataFrame:
    """conv_id, perspective, dialogue, masks: whole renderings, for conversations that fit in one value."""
    rows = F.sort_array(F.collect_list(F.struct("seg_start", "segment", "mask_start", "mask_end")))
    got = views.groupBy("conv_id", "perspective").agg(rows.alias("r"))
    masks = F.transform(F.filter("r", lambda x: x["mask_start"] >= 0), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return got.select("conv_id", "perspective", F.array_join(F.transform("r", lambda x: x["segment"]), "").alias("dialogue"), masks.alias("masks"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
v AS (SELECT t.*, p.perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || replace(replace(speaker, '<|', '< |'), chr(10), ' ') ELSE '' END || chr(10) AS header FROM v),
s AS (SELECT *, header || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, (sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY coalesce(turn, -1), speaker, text ROWS UNBOUNDED PRECEDING))::BIGINT AS seg_end FROM s)
SELECT conv_id, perspective, turn, speaker, role, segment, seg_end - length(segment) AS seg_start, seg_end,
       CASE WHEN role = 'assistant' THEN seg_end - length(segment) + length(header) ELSE -1 END AS mask_start, CASE WHEN role = 'assistant' THEN seg_end - 1 ELSE -1 END AS mask_end
FROM o"""
