"""Chat formatting by multi-party perspective rotation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of

#: Turns of a conversation whose offsets are summed in one task; longer ones are split.
BLOCK_TURNS = 64


def _rendered(c: DataFrame) -> DataFrame:
    """Turns in a perspective with role, name, head and segment."""
    role = F.when(F.col("speaker") == "system", "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    c = c.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    shown = F.regexp_replace(F.replace("name", F.lit("<|"), F.lit("< |")), r"[\x00-\x20\x7f\x{85}\x{a0}\x{2028}\x{2029}]+", "_")
    head = F.concat(F.lit("<|im_start|>"), "role", F.coalesce(F.concat(F.lit(" name="), shown), F.lit("")), F.lit("\n"))
    return c.withColumn("head", head).withColumn("segment", F.concat("head", "body", F.lit("<|im_end|>\n")))


def rotate(conversations: DataFrame) -> DataFrame:
    """A row for each participant of a conversation (perspective) and each of its turns.

    Participants are the distinct roles of a conversation but system; a null
    role is named unknown. In its own perspective a speaker is the assistant,
    all others are users under their name, and system turns stay system.
    segment is the turn as rendered; the dialogue is the segments in order of
    seq, and start_char and end_char are the segment's place in it (code
    points, end exclusive). trained says whether the turn's text and its end
    mark, from mask_start to mask_end, count in the loss; both are null
    elsewhere. The order is by turn (null last), role, text; control marks
    inside a text or a name are broken by a space, and in a rendered name each
    run of white space is one underscore, so that no name opens a turn or ends
    its line. A null text is empty. A turn with a null conv_id belongs to no known
    dialogue and is one of its own. A conversation of system turns alone has no
    row. There are as many rows as participants times turns.
    """
    c = columns_of(conversations, conv_id="long", turn="long", role="string", text="string")
    c = c.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"))
    alone = _rendered(c.where("conv_id is null and speaker != 'system'").withColumn("perspective", F.col("speaker")))
    alone = alone.withColumns({"seq": F.lit(1), "start_char": F.lit(0).cast("long"), "end_char": F.length("segment").cast("long")})
    # a null turn belongs to a last block
    c = c.where("conv_id is not null").withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(2**62)))
    who = c.where("speaker != 'system'").select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    c = _rendered(c.join(who, c.conv_id == who.of).drop("of"))

    keys = ["conv_id", "perspective"]
    sums = c.groupBy(*keys, "block").agg(F.sum(F.length("segment")).alias("long"), F.count("*").alias("turns"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("of"), F.col("perspective").alias("by"), F.col("block").alias("within"), F.coalesce(F.sum("long").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("first"))
    c = c.join(sums, (c.conv_id == sums.of) & (c.perspective == sums.by) & (c.block == sums.within))
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "body")
    run = F.sum(F.length("segment")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = c.withColumn("seq", F.col("first") + F.row_number().over(inside)).withColumn("end_char", F.col("base") + run)
    c = c.withColumn("start_char", F.col("end_char") - F.length("segment")).select(alone.columns).unionByName(alone).withColumn("trained", F.col("role") == "assistant")
    mask = lambda x: F.when(F.col("trained"), x)
    return c.select("conv_id", "perspective", F.col("seq").cast("long").alias("seq"), "turn", "role", "name", "segment", "start_char", "end_char", "trained", mask(F.col("start_char") + F.length("head")).alias("mask_start"), mask(F.col("end_char") - 1).alias("mask_end"))


#: The same rows for DuckDB.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body,
    CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM c WHERE speaker <> 'system'),
r AS (
  SELECT c.*, who.perspective,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM c JOIN who ON c.conv_id = who.conv_id
  UNION ALL SELECT c.*, speaker, 'assistant' FROM c WHERE conv_id IS NULL AND speaker <> 'system'),
h AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
    '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || regexp_replace(replace(speaker, '<|', '< |'), '[\x00-\x20\x7f\x{85}\x{a0}\x{2028}\x{2029}]+', '_', 'g') ELSE '' END || chr(10) AS head FROM r),
s AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (
  SELECT *, row_number() OVER w AS seq, CAST(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_char
  FROM s WINDOW w AS (PARTITION BY conv_id, own, perspective ORDER BY turn NULLS LAST, speaker, body))
SELECT conv_id, perspective, seq, turn, role, name, segment, end_char - length(segment) AS start_char, end_char,
  role = 'assistant' AS trained,
  CASE WHEN role = 'assistant' THEN end_char - length(segment) + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN end_char - 1 END AS mask_end
FROM o
"""
