"""Multi-party chat formatting by perspective rotation, in SQL functions only.

For every participant of a conversation (each role but ``system``) the dialogue is rendered
with that speaker as the assistant and all others as named users.  A rendering is a sequence
of segments, one per turn, in order of turn (then role and text):

    <|assistant|>\\n{text}<|end|>\\n        the speaker's own turns
    <|user name={role}|>\\n{text}<|end|>\\n  the others'
    <|system|>\\n{text}<|end|>\\n            system turns

The result has one row per conversation, speaker and turn: the segment, its place in the
rendering, and the loss mask as a span: of the speaker's own turns the text and the end
marker are trained on, of others nothing.  Segments joined in order are the rendering, so no
task ever holds a conversation: places are running sums taken in blocks of ``BLOCK_TURNS``
turns, plus the sums of earlier blocks.

Defined cases: NULL text is empty; a NULL role is the participant ``unknown``; rows with
a NULL conversation form one conversation; NULL turns come last; repeated rows are segments
of their own; ``<|`` inside a text or name becomes ``< |`` so that markers are unambiguous;
a conversation of system turns only has no participants and no rows; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm.common import table

BLOCK_TURNS = 1_024
END = "<|end|>\n"


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, speaker, turn, role, segment, start, end, mask_start, mask_end); places in code points."""
    def plain(c):
        return F.replace(c, F.lit("<|"), F.lit("< |"))
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     plain(F.coalesce(F.col(role_col), F.lit("unknown"))).alias("role"),
                     plain(F.coalesce(F.col(text_col), F.lit(""))).alias("body")) \
        .withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    people = t.where("role != 'system'").select(F.col("conv_id").alias("_c"), F.col("role").alias("speaker")).distinct()
    rows = t.join(people, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    mine = F.col("role") == F.col("speaker")
    head = F.when(mine, F.lit("<|assistant|>\n")).when(F.col("role") == "system", F.lit("<|system|>\n")) \
        .otherwise(F.concat(F.lit("<|user name="), F.col("role"), F.lit("|>\n")))
    # the segment is put together last, so that texts are exchanged once per row
    rows = rows.withColumn("n", (F.length(head) + F.length("body") + len(END)).cast("long"))
    # NULLs are made plain keys, so that the joins below are simple equi-joins
    keys = ["ck", "speaker", "bk"]
    rows = rows.withColumn("ck", F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00"))) \
        .withColumn("bk", F.coalesce("block", F.lit(2 ** 62)))
    totals = rows.groupBy(*keys).agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("ck", "speaker").orderBy("bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_last(), "role", "body") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("n").over(within)).join(offsets, keys)
    end = F.col("offset") + F.col("upto")
    return placed.select(
        "conv_id", "speaker", "turn", "role", F.concat(head, "body", F.lit(END)).alias("segment"), (end - F.col("n")).alias("start"), end.alias("end"),
        F.when(mine, end - F.col("n") + F.length(head)).alias("mask_start"), F.when(mine, end).alias("mask_end"))


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (
  SELECT t.conv_id, p.speaker, t.turn, t.role, t.body,
    CASE WHEN t.role = p.speaker THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>'
         ELSE '<|user name=' || t.role || '|>' END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM r),
e AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, role, body
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM s
)
SELECT conv_id, speaker, turn, role, segment, "end" - length(segment) AS start, "end",
  CASE WHEN role = speaker THEN "end" - length(segment) + length(head) END AS mask_start,
  CASE WHEN role = speaker THEN "end" END AS mask_end
FROM e
"""
