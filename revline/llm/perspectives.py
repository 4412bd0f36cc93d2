"""Chat formatting: every participant's view of a dialogue.

For each participant of a conversation the whole dialogue is rendered with that speaker as the assistant,
the other speakers as named users, and system turns as they are. The loss mask covers the contents and end
marks of the assistant's own turns. One row is one turn of one rendered dialogue: the rows of a
(conversation, perspective) in order of ``seq``, joined, are the training text, and ``char_start`` and
``mask_start`` count from its beginning. So a conversation of any length is never held in one row or task:
the offsets are sums over stretches of 256 turn numbers, and sums of those.

Defined results: a null or empty role is the speaker ``unknown``; a null text is empty; turns are ordered by
turn number (null first), speaker, text; repeated rows are turns of their own; a conversation of system
turns only has no participant and gives no row; a null conversation id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"
STRETCH = 256


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, seq, turn, chat_role, name, rendered, char_start, char_end, trained, mask_start, mask_end)."""
    t = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("")).alias("_c"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.floor(F.col(turn_col) / STRETCH), F.lit(-(1 << 62))).alias("_stretch"),
        F.when(F.coalesce(F.col(role_col), F.lit("")) == "", "unknown").otherwise(F.col(role_col)).alias("_speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    who = t.where("_speaker <> 'system'").select("_c", F.col("_speaker").alias("perspective")).distinct()
    role = F.when(F.col("_speaker") == "system", "system").when(F.col("_speaker") == F.col("perspective"), "assistant").otherwise("user")
    r = t.join(who, "_c").withColumn("chat_role", role) \
        .withColumn("name", F.when(F.col("chat_role") == "user", F.col("_speaker"))) \
        .withColumn("_head", F.concat(F.lit(HEAD), "chat_role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))) \
        .withColumn("rendered", F.concat("_head", "_text", F.lit(TAIL))) \
        .withColumn("_n", F.length("rendered").cast("long"))
    part = ["_c", "perspective", "_stretch"]
    inside = Window.partitionBy(*part).orderBy("turn", "_speaker", "_text").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_end", F.sum("_n").over(inside)).withColumn("_seq", F.row_number().over(
        Window.partitionBy(*part).orderBy("turn", "_speaker", "_text")))
    sums = r.groupBy(*part).agg(F.sum("_n").alias("_sum"), F.count("*").alias("_count"))
    before = Window.partitionBy("_c", "perspective").orderBy("_stretch")
    sums = sums.select(*part, (F.sum("_sum").over(before) - F.col("_sum")).alias("_chars"),
                       (F.sum("_count").over(before) - F.col("_count")).alias("_turns"))
    r = r.join(sums, part).withColumn("char_end", F.col("_chars") + F.col("_end")) \
        .withColumn("char_start", F.col("char_end") - F.col("_n")) \
        .withColumn("trained", F.col("chat_role") == "assistant")
    return r.select(
        "conv_id", "perspective", (F.col("_turns") + F.col("_seq")).alias("seq"), "turn", "chat_role", "name", "rendered",
        "char_start", "char_end", "trained",
        F.when(F.col("trained"), F.col("char_start") + F.length("_head")).alias("mask_start"),
        F.when(F.col("trained"), F.col("char_end") - 1).alias("mask_end"))
