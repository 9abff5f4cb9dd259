"""Chat formatting by multi-party perspective rotation.

Every participant of a dialogue gets a rendering of it in which its own turns are the assistant's, the turns of
all others are those of users by name, and the mask covers exactly what that assistant says. System turns belong
to nobody and are shown in every rendering.

A dialogue is rendered in chunks of SPAN turn numbers, so a dialogue of any length is a row of chunks in order
and no task gathers more than a chunk. Where more than CROWD rows share the turn numbers of a chunk, because turn
numbers repeat, each turn number is a chunk of its own, cut by the part of the table its rows came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wastelake.llm.common import with_place
from wastelake.session import materialize

SPAN, CROWD = 1024, 8192
START, NEWLINE, END = "<|start|>", "\n", "<|end|>\n"
#: A marker's opening inside a text is broken apart, so that no text can end a turn or begin one.
OPENING, BROKEN = "<|", "< |"
SYSTEM, NOBODY = "system", "unknown"


def _head(role: Column, perspective: Column) -> Column:
    name = F.when(role == perspective, "assistant").when(role == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user "), role))
    return F.concat(F.lit(START), name, F.lit(NEWLINE))


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(OPENING), F.lit(BROKEN))


def chunks(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = SPAN, crowd: int = CROWD) -> DataFrame:
    """conv_id, first_turn, piece, said: the turns of each chunk in order of (turn, place in the table)."""
    named = lambda c: F.col(f"`{c}`")
    rows, _ = with_place(turns.select(named(conv).alias("conv_id"), named(turn).cast("long").alias("turn"), F.coalesce(_plain(named(role)), F.lit("")).alias("role"), _plain(named(text)).alias("text")))
    rows = rows.withColumn("role", F.when(F.col("role") == "", NOBODY).otherwise(F.col("role"))).withColumn("bucket", F.floor(F.col("turn") / span) * span)
    crowded = rows.groupBy("conv_id", "bucket").count().where(F.col("count") > crowd).select(F.col("conv_id").alias("c"), F.col("bucket").alias("b"), F.lit(True).alias("crowd"))
    marked = rows.join(crowded, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("bucket").eqNullSafe(F.col("b")), "left").withColumn("cut", F.col("crowd").isNotNull())
    first = F.when(F.col("cut"), F.col("turn")).otherwise(F.col("bucket"))
    piece = F.when(F.col("cut"), F.shiftright("_row", 33)).otherwise(0).cast("long")
    placed = marked.select("conv_id", first.alias("first_turn"), piece.alias("piece"), F.struct(F.col("turn").isNull().alias("none"), "turn", F.col("_row").alias("row"), "role", "text").alias("said"))
    return placed.groupBy("conv_id", "first_turn", "piece").agg(F.array_sort(F.collect_list("said")).alias("said"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = SPAN, crowd: int = CROWD) -> DataFrame:
    """conv_id, perspective, first_turn, piece, n_turns, text, mask for every participant and chunk.

    `mask` holds (start, end) in code points, end exclusive, of what the participant says with its end mark; a
    chunk in which it is silent has an empty mask. Order the chunks of a rendering by (first_turn, piece), null
    last. A null or empty role is the participant 'unknown', a null text is empty, a null turn comes last, null
    conversations are one dialogue, repeated rows are repeated turns; a dialogue of system turns alone has no
    participant and no rendering. Other columns are not read; an empty table gives no rows.
    """
    cut = materialize(chunks(turns, conv, turn, role, text, span, crowd), "chunks")
    people = cut.select("conv_id", F.explode(F.array_distinct(F.transform("said", lambda s: s["role"]))).alias("perspective")).where(F.col("perspective") != SYSTEM).distinct()
    people = materialize(people.withColumnRenamed("conv_id", "c"), "people")
    seen = cut.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    me = F.col("perspective")
    parts = F.transform("said", lambda s: F.struct((s["role"] == me).alias("own"), F.length(_head(s["role"], me)).alias("head"), F.concat(_head(s["role"], me), s["text"], F.lit(END)).alias("shown")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def add(s: Column, p: Column) -> Column:
        end = s["at"] + F.length(p["shown"])
        own = F.array(F.struct((s["at"] + p["head"]).alias("start"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(s["spans"], own)).otherwise(s["spans"]).alias("spans"))

    shown = seen.withColumn("parts", parts)
    return shown.select(
        "conv_id", "perspective", "first_turn", "piece", F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: p["shown"]), "").alias("text"),
        F.aggregate("parts", start, add, lambda s: s["spans"]).alias("mask"),
    )


def op7(turns: DataFrame) -> DataFrame:
    """All conversations from every participant's side, masks written as start:end."""
    out = rotate(turns)
    return out.withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","))


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(nullif(replace(role, '{OPENING}', '{BROKEN}'), ''), '{NOBODY}') AS role, replace(coalesce(text, ''), '{OPENING}', '{BROKEN}') AS text, turn // {SPAN} * {SPAN} AS first_turn FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{SYSTEM}'),
h AS (SELECT t.*, perspective, '{START}' || CASE WHEN role = perspective THEN 'assistant' WHEN role = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user ' || role END || chr(10) AS head FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS shown FROM h),
o AS (SELECT *, (sum(length(shown)) OVER (PARTITION BY conv_id, perspective, first_turn ORDER BY turn))::BIGINT AS finish FROM s)
SELECT conv_id, perspective, first_turn, 0::BIGINT AS piece, count(*) AS n_turns, string_agg(shown, '' ORDER BY turn) AS text,
  coalesce(string_agg(CASE WHEN role = perspective THEN (finish - length(shown) + length(head)) || ':' || (finish - 1) END, ',' ORDER BY turn), '') AS mask
FROM o GROUP BY conv_id, perspective, first_turn
"""
