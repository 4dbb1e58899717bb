"""Multi-party perspective rotation of dialogues (operator 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one rendered part: a longer dialogue is rendered in consecutive parts, each with its own offsets.
PART_TURNS = 512
START, END = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Each dialogue once for every participant, who speaks as the assistant.

    ``turns`` has conv_id, turn, role and text. Participants are a dialogue's
    roles but ``system`` and null. The speaker's turns are rendered as the
    assistant, system turns as system, others as users with their name (a null
    role has none). Returns conv_id, speaker, part, n_turns, text and trained:
    the code point spans ``start:end`` of the speaker's words with their end
    mark, comma-joined; all else is masked.

    Turns are ordered by (turn, role, text), nulls first; part is turn divided
    by ``part_turns``, rounded down (null for null turns). Exactly repeated
    turns count once; null texts are empty. A null conv_id is a dialogue.
    Dialogues without participants give no row, and so does an empty table;
    other columns are ignored. No group holds more than one part.
    """
    part = F.floor(F.col("turn") / part_turns).cast("long")
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    who = turns.where("role is not null and role <> 'system'").select(
        F.col("conv_id").alias("__conv"), F.col("role").alias("speaker")).distinct()
    pairs = rows.join(who, F.col("conv_id").eqNullSafe(F.col("__conv")), "inner")
    own = F.coalesce(F.col("role") == F.col("speaker"), F.lit(False))
    head = F.concat(F.lit(START), F.when(own, "assistant").when(F.col("role") == "system", "system")
                    .otherwise(F.concat(F.lit("user"), F.coalesce(F.concat(F.lit(" name="), F.col("role")), F.lit("")))), F.lit("\n"))
    pairs = pairs.select("conv_id", "speaker", part.alias("part"), "turn", "role", "text", own.alias("own"), head.alias("head"))
    size = F.length("head") + F.length("text") + F.lit(len(END) + 1)
    order = Window.partitionBy("conv_id", "speaker", "part").orderBy("turn", "role", "text")
    placed = pairs.withColumn("start", F.sum(size).over(order) - size).select(
        "conv_id", "speaker", "part", F.struct(
            "start", F.concat("head", "text", F.lit(END + "\n")).alias("shown"),
            F.when(F.col("own"), F.concat_ws(":", F.col("start") + F.length("head"),
                                             F.col("start") + size - 1)).alias("span")).alias("t"))
    out = placed.groupBy("conv_id", "speaker", "part").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return out.select("conv_id", "speaker", "part", F.size("t").cast("long").alias("n_turns"),
                      F.array_join(F.col("t.shown"), "").alias("text"), F.array_join(F.col("t.span"), ",").alias("trained"))
