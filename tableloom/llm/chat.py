"""Dialogues of several speakers, rendered once from each speaker's side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.windows import with_position

SALTS = 64
#: Turns per segment: what one row may gather.
SEGMENT_TURNS = 512


def rotate_perspectives(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    narrator: str = "system", segment_turns: int = SEGMENT_TURNS,
) -> DataFrame:
    """(conv_id, speaker, segment, n_turns, text, spans): every dialogue from the side of each participant.

    In a participant's rendering that speaker is the assistant, every other speaker a user with a
    name, and ``narrator`` turns stay system turns; ``spans`` are the character ranges [start, end)
    of ``text`` to train on: the participant's own words and the end mark after them.

    A row holds ``segment_turns`` turns by their rank in the dialogue: dialogues up to that long are one row, longer
    ones go on in the next segments, whatever repeats. Concatenating the segments in order gives the whole
    rendering. Turns are ranked by number, null last; ties go by role, then by text; ranks come from range partitions,
    so a long dialogue is no hot key. A null role is the speaker ``unknown``; a null text is empty; a null
    conversation is one conversation of its own; other columns are ignored; an empty table gives an empty result.
    Marks inside texts lose their bar (``<|`` becomes ``<``), so texts cannot forge turns. A
    conversation of narrator turns alone has no participant and no row.
    """
    turn = F.col(turn_col).cast("long")
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"), turn.alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("said"),
    ).withColumn("row", F.monotonically_increasing_id())  # so that equal rows spread over range partitions too
    placed = with_position(turns, [F.col("turn").asc_nulls_last(), "role", "said", "row"], ["conv_id"], "at", plain_rows=0)
    segments = placed.withColumn("segment", F.floor(F.col("at") / segment_turns)).groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("at", "role", "said"))).alias("turns"), F.collect_set(F.when(F.col("role") != narrator, F.col("role"))).alias("here"),
    )
    # the segments of one conversation are spread, each share with its own copy of the speakers
    segments = segments.withColumn("salt", F.pmod(F.col("segment"), F.lit(SALTS)))
    people = segments.select(F.col("conv_id").alias("_of"), F.explode("here").alias("speaker")).distinct()
    shares = segments.select(F.col("conv_id").alias("_conv"), F.col("salt").alias("_salt")).distinct()
    people = shares.join(people, F.col("_conv").eqNullSafe(F.col("_of"))).drop("_of")
    seen = segments.drop("here").join(people, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("salt") == F.col("_salt"))).drop("_conv", "_salt", "salt")

    def head(t: Column) -> Column:
        named = F.concat(F.lit("user name="), F.replace(t["role"], F.lit("<|"), F.lit("<")))
        kind = F.when(t["role"] == narrator, F.lit("system")).when(t["role"] == F.col("speaker"), F.lit("assistant")).otherwise(named)
        return F.concat(F.lit("<|im_start|>"), kind, F.lit("\n"))

    pieces = F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), F.concat(F.replace(t["said"], F.lit("<|"), F.lit("<")), F.lit("<|im_end|>")).alias("body"),
        ((t["role"] == F.col("speaker")) & (t["role"] != narrator)).alias("own"),
    ))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return seen.withColumn("pieces", pieces).select(
        "conv_id", "speaker", "segment", F.size("turns").alias("n_turns"),
        F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n")))).alias("text"),
        F.aggregate("pieces", start, step, lambda acc: acc["spans"]).alias("spans"),
    )
