"""Preference pairs for chat models: one prompt and two masked completions; DataFrame functions only.

The longest common prefix of turns of the chosen and the rejected conversation is the prompt; what
follows on either side is its completion, in which only the assistant's text (with its end marker)
is trained on.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """``pair_id, chosen, rejected`` from rows ``conv_id, turn, role, text``, one per conversation.

    Chosen is the conversation up to its last assistant turn.  Rejected has in that turn's place a
    stale answer: the assistant turn before it, or the first half of the reply (rounded down) where
    there is none or it says the same.  Without an assistant turn both are the whole conversation.
    Turns are ordered by number, role and text, nulls first, and a row that is repeated as a whole
    counts once; a null role is ``unknown``, a null text empty."""
    one = F.struct("turn", F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
                   F.coalesce(F.col("text"), F.lit("")).alias("text"))
    c = (conversations.select("conv_id", one.alias("t")).groupBy("conv_id")
         .agg(F.sort_array(F.collect_set("t")).alias("t"))
         .select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("t")))
    is_reply = F.transform("t", lambda t: t["role"] == "assistant")
    c = c.withColumn("replies", F.filter(F.transform(is_reply, lambda x, i: F.when(x, i)), lambda i: i.isNotNull()))
    last = F.element_at("replies", -1)
    c = c.withColumn("last", F.when(F.size("replies") > 0, last).otherwise(F.size("t") - 1))
    reply = F.get("t", F.col("last"))["text"]
    before = F.get("t", F.get("replies", F.size("replies") - 2))["text"]
    stale = F.when(before.isNotNull() & (before != reply), before).otherwise(
        F.substring(reply, F.lit(1), F.floor(F.length(reply) / 2).cast("int")))
    chosen = F.slice("t", F.lit(1), F.col("last") + 1)
    rejected = F.concat(F.slice("t", F.lit(1), F.col("last")), F.array(F.struct(F.lit("assistant").alias("role"), stale.alias("text"))))
    return c.select(F.col("conv_id").alias("pair_id"), chosen.alias("chosen"),
                    F.when(F.size("replies") > 0, rejected).otherwise(chosen).alias("rejected"))


def _escape(text: Column) -> Column:
    """Markers inside a text are no markers."""
    return F.replace(text, F.lit("<|im_"), F.lit("<\\|im_"))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(START), _escape(turn["role"]), F.lit("\n"), _escape(turn["text"]), F.lit(END + "\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """start:end (code points, end exclusive) of the assistant's text and end marker, comma-joined."""
    def step(acc: Column, t: Column) -> Column:
        at = acc["at"] + F.length(_render(t))
        span = F.concat((acc["at"] + F.length(_escape(t["role"])) + len(START) + 1).cast("string"), F.lit(":"),
                        (at - 1).cast("string"))
        return F.struct(at.cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"))
    return F.array_join(F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("at"),
                                                    F.array().cast("array<string>").alias("out")), step)["out"], ",")


def format_preferences(pairs: DataFrame, id_col: str = "pair_id", chosen_col: str = "chosen",
                       rejected_col: str = "rejected") -> DataFrame:
    """``pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask``.

    Equal conversations have empty completions and masks; a null or empty conversation has no turns;
    null roles and texts are ``unknown`` and empty; repeated rows and null ids are kept.  Markers of
    the template inside a text are escaped, so a text cannot open a turn."""
    clean = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(f"array<{TURN}>")), lambda t: F.struct(
        F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    p = pairs.select(F.col(id_col).alias("pair_id"), clean(chosen_col).alias("c"), clean(rejected_col).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.slice("c", F.lit(1), shorter), lambda t, i: t == F.get("r", i))
    differs = F.array_position(same, False)
    p = p.withColumn("n", F.when(differs == 0, shorter).otherwise(differs - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    return p.select("pair_id", F.col("n").alias("n_prompt_turns"), _joined(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
                    _joined(rest("c")).alias("chosen"), _mask(rest("c")).alias("chosen_mask"),
                    _joined(rest("r")).alias("rejected"), _mask(rest("r")).alias("rejected_mask"))
