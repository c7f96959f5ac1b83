"""Chat formatting: a dialogue from the view of each of its participants.

For every participant the whole dialogue is rendered with that speaker as the assistant and the
others as named users, with the places of the assistant's own words as the mask of what a model
learns. Instructions of the roles in ``SETTING`` set the scene: they stay what they are in every
view and are no participants.

A dialogue of up to ``SEGMENT`` turns is one text. A longer one is cut after every ``SEGMENT`` turns
into texts that continue each other: put together in the order of their segments they are the
whole rendering, with every instruction where it was given. Its turns are counted by keys and hashes
of texts, in a distributed sort, so that no task needs all of them; the texts are then dealt out by
segment. Dialogues that are not longer go straight to their one group, and texts move once.

What delimits turns cannot be forged by a message or a name: there ``<|`` is written ``<\\|``, and a
backslash after ``<`` is doubled, which can be undone; names also have their line ends and ``|>``
written that way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import numbered, stored, table

SEGMENT = 1024
SETTING = ["system"]
ASSISTANT = "assistant"
OPEN, CLOSE = "<|", "|>\n"
END = "\n<|end|>\n"
NOBODY = "unknown"


def escaped(text: Column) -> Column:
    """A text without the opening of a delimiter."""
    doubled = F.replace(text, F.lit("<\\"), F.lit("<\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def _name(speaker: Column) -> Column:
    """A speaker's name on one line, without a closing delimiter."""
    shown = F.replace(F.replace(escaped(speaker), F.lit("|>"), F.lit("|\\>")), F.lit("\r"), F.lit("\\r"))
    return F.replace(shown, F.lit("\n"), F.lit("\\n"))


def _header(turn: Column, view: Column) -> Column:
    name = (
        F.when(turn["speaker"].isin(SETTING), turn["speaker"])
        .when(turn["speaker"] == view, F.lit(ASSISTANT))
        .otherwise(F.concat(F.lit("user name="), _name(turn["speaker"])))
    )
    return F.concat(F.lit(OPEN), name, F.lit(CLOSE))


def _segments(rows: DataFrame, segment: int) -> DataFrame:
    """``(conv_id, segment, turns, voices)`` of distinct ``rows(conv_id, turn, speaker, label, said)``.

    ``voices`` are the participants of the whole dialogue.
    """
    turns = F.sort_array(F.collect_set(F.struct("turn", "speaker", "label", "said"))).alias("turns")
    voice = F.when(~F.col("speaker").isin(SETTING), F.col("speaker"))
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > segment)
    long = stored(counts.select(F.col("conv_id").alias("_long"), F.lit(True).alias("is_long")), "long")
    flagged = rows.join(long, F.col("conv_id").eqNullSafe(F.col("_long")), "left").drop("_long")
    short = flagged.where("is_long is null").groupBy("conv_id").agg(
        turns, F.array_sort(F.array_compact(F.collect_set(voice))).alias("voices")
    )
    short = short.select("conv_id", F.lit(0).cast("bigint").alias("segment"), "turns", "voices")
    if long.isEmpty():
        return short
    long_rows = flagged.where("is_long").drop("is_long")
    keys = ["conv_id", "turn", "speaker", "label"]
    placed = numbered(long_rows.select(*keys).distinct(), "conv_id", keys[1:])
    placed = placed.select(*(F.col(k).alias(f"_{k}") for k in keys), F.floor(F.col("place") / segment).cast("bigint").alias("segment"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    cut = long_rows.join(placed, same).groupBy("conv_id", "segment").agg(turns)
    named = long_rows.groupBy(F.col("conv_id").alias("_conv")).agg(
        F.array_sort(F.array_compact(F.collect_set(voice))).alias("voices")
    )
    cut = cut.join(named, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    return short.unionByName(cut)


def perspectives(
    turns: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    segment: int = SEGMENT,
) -> DataFrame:
    """``(conv_id, speaker, segment, n_turns, text, mask)`` for each participant and segment.

    ``mask`` has ``start:end`` of the speaker's own words, comma-joined, in code points of
    ``text``, the end exclusive; it is empty where the speaker has no turn. Turns follow by number,
    NULL first, those of one number by speaker and the MD5 of their text; equal rows are one turn. A
    NULL or empty speaker is ``unknown``, a NULL text empty; rows with a NULL conversation are one
    conversation. Texts of any length are rendered whole; ``segment`` bounds how many turns one task
    puts together. A dialogue without participants has no view. Other columns are not read.
    """
    role = F.coalesce(F.nullif(F.trim(F.col(role_column).cast("string")), F.lit("")), F.lit(NOBODY))
    said = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv_column).alias("conv_id"),
        F.col(turn_column).cast("bigint").alias("turn"),
        role.alias("speaker"),
        F.md5(said.cast("binary")).alias("label"),
        escaped(said).alias("said"),
    )
    seen = _segments(rows, segment).select("conv_id", "segment", "turns", F.explode("voices").alias("view"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(_header(t, F.col("view")), t["said"], F.lit(END)).alias("part"),
            F.length(_header(t, F.col("view"))).alias("skip"),
            F.length(t["said"]).alias("size"),
            (t["speaker"] == F.col("view")).alias("own"),
        ),
    )
    turned = seen.select("conv_id", F.col("view").alias("speaker"), "segment", parts.alias("parts"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    mask = F.aggregate(
        "parts",
        begin,
        lambda done, p: F.struct(
            (done["at"] + F.length(p["part"])).alias("at"),
            F.when(
                p["own"],
                F.concat(
                    done["spans"],
                    F.array(F.concat_ws(":", done["at"] + p["skip"], done["at"] + p["skip"] + p["size"])),
                ),
            )
            .otherwise(done["spans"])
            .alias("spans"),
        ),
        lambda done: F.array_join(done["spans"], ","),
    )
    return turned.select(
        "conv_id",
        "speaker",
        "segment",
        F.size("parts").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"),
        mask.alias("mask"),
    )


def op1_chat_perspectives(spark, sf_dir):
    """Every dialogue from the view of each of its participants."""
    return perspectives(table(spark, sf_dir, "conversations"))


ORACLE_OP1 = r"""
WITH given AS (
  SELECT DISTINCT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker,
         coalesce(text, '') AS text
  FROM conversations),
turns AS (
  SELECT *, replace(replace(text, '<\', '<\\'), '<|', '<\|') AS said,
         replace(replace(replace(replace(replace(speaker, '<\', '<\\'), '<|', '<\|'), '|>', '|\>'),
                         chr(13), '\r'), chr(10), '\n') AS name,
         (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, md5(text)) - 1)
           // 1024 AS segment,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, md5(text)) AS place
  FROM given),
views AS (SELECT DISTINCT conv_id, speaker AS view FROM turns WHERE speaker <> 'system'),
parts AS (
  SELECT t.conv_id, v.view, t.segment, t.place, t.speaker, t.said,
         '<|' || CASE WHEN t.speaker = 'system' THEN t.speaker WHEN t.speaker = v.view THEN 'assistant'
                      ELSE 'user name=' || t.name END || '|>' || chr(10) AS header
  FROM turns t JOIN views v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
placed AS (
  SELECT *, header || said || chr(10) || '<|end|>' || chr(10) AS part,
         coalesce(sum(length(header) + length(said) + 9) OVER (
           PARTITION BY conv_id, view, segment ORDER BY place
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM parts)
SELECT conv_id, view AS speaker, segment, count(*) AS n_turns,
       string_agg(part, '' ORDER BY place) AS text,
       coalesce(string_agg(CASE WHEN speaker = view THEN
         CAST(CAST(start AS BIGINT) + length(header) AS VARCHAR) || ':' ||
         CAST(CAST(start AS BIGINT) + length(header) + length(said) AS VARCHAR) END, ','
         ORDER BY place), '') AS mask
FROM placed GROUP BY conv_id, view, segment
"""
