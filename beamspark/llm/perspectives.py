"""Multi-party perspective rotation of conversations.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant, the others as
named users and the system's turns as system, with the character spans that the assistant says (text and end mark) as
the mask to train on. Long conversations come in parts of ``PART_TURNS`` turn numbers, so that no row holds an unbounded
dialogue; a part's spans count from its own start, and parts follow each other in turn order.

Everything is DataFrame functions. One shuffle gathers the turns of a part, narrow ones the participants of a conversation
(distinct names, pre-aggregated). A part holds the rows of its 64 turn numbers, however often these repeat. Turns of a part are ordered by turn, speaker and text; equal rows all stay. Marks inside a
text are broken up, so that a text can't forge a turn. Null speakers are named ``NAMELESS``, null texts are empty, null turns
come first in a part of their own, null conversations are one conversation. Conversations with system turns alone have no
participant and give no rows; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 64
NAMELESS = "unknown"
SYSTEM = "system"
END = "<|end|>\n"


def safe(text: Column) -> Column:
    """Text in which no turn mark can begin."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotated(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
            part_turns: int = PART_TURNS) -> DataFrame:
    """Rows (conv_id, perspective, part, n_turns, rendered, mask): mask is an array of spans (begin, finish) of characters."""
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(speaker), F.lit(NAMELESS)).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({
        "key": F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")),  # never null, so that it joins
        "part": F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long")})
    parts = rows.groupBy("key", "part").agg(
        F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))
    people = rows.where(F.col("speaker") != SYSTEM).groupBy("key").agg(F.array_sort(F.collect_set("speaker")).alias("people"))
    # The names go to the parts, by the key that the parts are already dealt by: texts move once.
    by_part = rows.select("key", "part").distinct().join(people, "key")
    both = parts.join(by_part, ["key", "part"])
    views = both.select("conv_id", "part", "turns", F.explode("people").alias("perspective"))

    def head(t: Column) -> Column:
        return F.when(t["speaker"] == F.col("perspective"), "<|assistant|>\n").when(t["speaker"] == SYSTEM, "<|system|>\n").otherwise(
            F.concat(F.lit("<|user name="), safe(t["speaker"]), F.lit("|>\n")))

    said = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(safe(t["text"]), F.lit(END)).alias("body"), (t["speaker"] == F.col("perspective")).alias("own")))
    views = views.withColumn("said", said)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,finish:bigint>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(s["head"])
        finish = begin + F.length(s["body"])
        span = F.array(F.struct(begin.cast("long").alias("begin"), finish.cast("long").alias("finish")))
        return F.struct(finish.cast("long").alias("at"), F.when(s["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return views.select("conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"),
                        F.array_join(F.transform("said", lambda s: F.concat(s["head"], s["body"])), "").alias("rendered"),
                        F.aggregate("said", start, step, lambda acc: acc["spans"]).alias("mask"))


def mask_text(mask: str = "mask") -> Column:
    """Spans as text: begin-finish, comma-joined."""
    return F.array_join(F.transform(mask, lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["finish"].cast("string"))), ",")


SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '{NAMELESS}') AS speaker, coalesce(text, '') AS text,
         coalesce(CAST(floor(turn / {PART_TURNS}) AS BIGINT), -1) AS part FROM conversations),
people AS (SELECT DISTINCT conv_id AS of, speaker AS perspective FROM rows WHERE speaker <> '{SYSTEM}'),
said AS (
  SELECT conv_id, perspective, part, turn, speaker, text, speaker = perspective AS own,
         CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = '{SYSTEM}' THEN '<|system|>'
              ELSE '<|user name=' || replace(speaker, '<|', '< |') || '|>' END || chr(10) AS head,
         replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM rows JOIN people ON conv_id IS NOT DISTINCT FROM of),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (
    PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING) AS finish FROM said)
SELECT conv_id, perspective, part, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, speaker, text) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN CAST(finish - length(body) AS VARCHAR) || '-' || CAST(finish AS VARCHAR) END, ',' ORDER BY finish), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""
