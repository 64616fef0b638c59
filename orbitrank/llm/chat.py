"""Chat formatting with rotated perspectives, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered once, with that
participant as the assistant and the others as named users. ``spans`` marks what a
model is trained on: the assistant's words and the end mark after them.

A conversation is rendered in parts of ``part_turns`` turn numbers, so that no task
holds more than a part, however long the conversation is; ``offset`` is where a part
begins in the whole dialogue, which is the parts' texts one after the other.

Defined results: rows without a role belong to the speaker ``unknown``; null text is
empty; rows of one turn number are rendered in order of role and text, and repeated
rows are all rendered; a null turn number comes after all others; a null conversation
id is a conversation of its own; system rows are rendered alike in every perspective
and have no perspective of their own, so a conversation of nothing else has none.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers in a part.
PART_TURNS = 64
SYSTEM_ROLES = ("system",)
UNNAMED = "unknown"
END = "<|end|>"


def _part(turn: Column, size: int) -> Column:
    return F.coalesce(F.floor(turn / size).cast("long"), F.lit(2**63 - 1))


def render(turns: Column, speaker: Column) -> Column:
    """Struct (text, spans) of a part's ordered turns as ``speaker`` sees them."""
    def step(state: Column, turn: Column) -> Column:
        own = turn["role"].eqNullSafe(speaker)
        system = turn["role"].isin(*SYSTEM_ROLES)
        head = (
            F.when(system, F.concat(F.lit("<|system|>\n")))
            .when(own, F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user:"), turn["role"], F.lit("|>\n")))
        )
        begin = state["at"] + F.length(head)
        end = begin + F.length(turn["text"]) + len(END)
        span = F.array(F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end")))
        return F.struct(
            (end + 1).cast("long").alias("at"),
            F.concat(state["pieces"], F.array(F.concat(head, turn["text"], F.lit(END + "\n")))).alias("pieces"),
            F.when(own & ~system, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<string>").alias("pieces"),
        F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"),
    )
    return F.aggregate(turns, start, step, lambda state: F.struct(
        F.array_join(state["pieces"], "").alias("text"), state["spans"].alias("spans"),
        state["at"].alias("length"),
    ))


def rotate_perspectives(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per (conversation, participant, part): conv_id, speaker, part, offset,
    n_turns, text, spans; offset and spans count code points."""
    rows = conversations.select(
        F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit(UNNAMED)).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"), _part(F.col("turn"), part_turns).alias("part"),
    )
    turn = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    speakers = rows.where(~F.col("role").isin(*SYSTEM_ROLES)).select(
        F.col("conv_id").alias("of"), F.col("role").alias("speaker")
    ).distinct()
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "speaker", "part", F.size("turns").alias("n_turns"),
        render(F.col("turns"), F.col("speaker")).alias("made"),
    )
    earlier = (
        Window.partitionBy("conv_id", "speaker").orderBy("part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return seen.select(
        "conv_id", "speaker", "part",
        F.coalesce(F.sum("made.length").over(earlier), F.lit(0)).cast("long").alias("offset"),
        "n_turns", F.col("made.text").alias("text"), F.col("made.spans").alias("spans"),
    )


def spans_text(spans: Column) -> Column:
    """Spans as ``begin-end`` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ","
    )


PERSPECTIVES_SQL = """
WITH r AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
        coalesce(CAST(floor(turn / 64) AS BIGINT), 9223372036854775807) AS part FROM conversations
), v AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
h AS (
    SELECT r.*, v.speaker, r.role = v.speaker AS own, CASE WHEN r.role = 'system' THEN '<|system|>' || chr(10)
        WHEN r.role = v.speaker THEN '<|assistant|>' || chr(10)
        ELSE '<|user:' || r.role || '|>' || chr(10) END AS head
    FROM r JOIN v ON r.conv_id IS NOT DISTINCT FROM v.conv_id
), p AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS LAST, role, text) AS n,
        length(head) + length(text) + 8 AS len FROM h
), a AS (
    SELECT *, coalesce(sum(len) OVER (PARTITION BY conv_id, speaker, part ORDER BY n
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p
), g AS (
    SELECT conv_id, speaker, part, count(*) AS n_turns, sum(len) AS len,
        string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY n) AS text,
        coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || '-'
            || CAST(pos + length(head) + length(text) + 7 AS BIGINT), ',' ORDER BY n)
            FILTER (WHERE own), '') AS spans
    FROM a GROUP BY 1, 2, 3
)
SELECT conv_id, speaker, part, CAST(coalesce(sum(len) OVER (PARTITION BY conv_id, speaker ORDER BY part
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    CAST(n_turns AS INTEGER) AS n_turns, text, spans FROM g
"""
