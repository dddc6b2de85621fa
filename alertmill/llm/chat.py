"""Chat formatting by perspective rotation, in DataFrame functions alone.

Method: for every participant of a dialogue the dialogue is rendered with that speaker as the assistant and the others as
named users; the loss mask covers what the assistant says. The result is a row for each turn and perspective, with its
place in the rendering, so that a dialogue of any length is spread over tasks: joined in order of position, the rows are
the rendering.

Offsets are prefix sums in two levels. Rows are range-partitioned by dialogue, perspective and turn; sums run inside each
partition, then over one row for each partition that a dialogue meets.

A missing, blank or null role is the speaker "unknown"; a null text is empty; a null conv_id is a dialogue of its own.
Turns are in order of turn (nulls first), then speaker, then text; repeated rows are repeated turns. Marks of the format
inside a text are broken up, so that no text can open a turn. Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame) -> DataFrame:
    speaker = F.coalesce(F.nullif(F.trim(F.col("role").cast("string")), F.lit("")), F.lit("unknown"))
    text = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"), text.alias("text"))


def head(is_assistant: Column) -> Column:
    name = F.regexp_replace("speaker", "[^\\p{L}\\p{N}_.-]", "_")
    return F.when(is_assistant, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, position (from 0), turn, role, name, rendered, start, end (code points, the end exclusive),
    and mask_start and mask_end of what is learned: the assistant's text and its end mark, and nothing of the
    others' (mask_start = mask_end)."""
    own = turns(conversations)
    who = own.select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    each = own.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    order = ["conv_id", "perspective", "turn", "speaker", "text"]
    is_assistant = F.col("speaker") == F.col("perspective")
    each = each.withColumn("head", head(is_assistant)).repartitionByRange(*order).sortWithinPartitions(*order)
    # the id's upper bits are the partition, and it grows with the order inside
    each = written(each.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33)), "turns")

    size = F.length("head") + F.length("text") + len(CLOSE) + 1
    sizes = each.select("conv_id", "perspective", "part", "id", size.cast("long").alias("size"))
    inside = Window.partitionBy("conv_id", "perspective", "part").orderBy("id")
    local = sizes.select("id", "conv_id", "perspective", "part", "size", (F.row_number().over(inside) - 1).cast("long").alias("at"), (F.sum("size").over(inside) - F.col("size")).alias("begin"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("conv_id", "perspective", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    firsts = totals.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("part").alias("q"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size0"))
    placed = local.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("part") == F.col("q")))
    placed = placed.select("id", (F.col("at") + F.col("n0")).alias("position"), (F.col("begin") + F.col("size0")).alias("start"), (F.col("begin") + F.col("size0") + F.col("size")).alias("end"))

    mine = F.col("speaker") == F.col("perspective")
    return each.join(placed, "id").select(
        "conv_id",
        "perspective",
        "position",
        "turn",
        F.when(mine, F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        F.when(~mine, F.col("speaker")).alias("name"),
        F.concat("head", "text", F.lit(f"{CLOSE}\n")).alias("rendered"),
        "start",
        "end",
        F.when(mine, F.col("start") + F.length("head")).otherwise(F.col("start")).alias("mask_start"),
        F.when(mine, F.col("end") - 1).otherwise(F.col("start")).alias("mask_end"),
    )


#: The same in DuckDB.
SQL = """
WITH own AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role, ' '), ''), 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), who AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM own),
each AS (
  SELECT *, speaker = perspective AS mine,
    CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
         ELSE '<|im_start|>user name=' || regexp_replace(speaker, '[^\\p{L}\\p{N}_.-]', '_', 'g') || chr(10) END AS head
  FROM own JOIN who ON conv_id IS NOT DISTINCT FROM c
), sized AS (SELECT *, length(head) + length(text) + 11 AS size FROM each),
placed AS (
  SELECT *, row_number() OVER w - 1 AS position, sum(size) OVER w AS stop
  FROM sized WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, position, turn, CASE WHEN mine THEN 'assistant' ELSE 'user' END AS role, CASE WHEN NOT mine THEN speaker END AS name,
  head || text || '<|im_end|>' || chr(10) AS rendered, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end",
  CAST(CASE WHEN mine THEN stop - size + length(head) ELSE stop - size END AS BIGINT) AS mask_start, CAST(CASE WHEN mine THEN stop - 1 ELSE stop - size END AS BIGINT) AS mask_end
FROM placed
"""
