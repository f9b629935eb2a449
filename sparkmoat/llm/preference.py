"""Preference data: pairs of conversations with their common turns rendered once and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, salted_join

#: How a turn is rendered: its head, its text, its end.
HEAD, END = "<|{}|>\n", "<|end|>\n"
#: The role whose words a model is to learn.
LEARNED = "assistant"


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns array<struct<turn, role, text>>): each conversation's turns in order.

    A null role is "unknown" and a null text empty; rows without a conversation
    are left out. Turns with equal numbers go by role, then text.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("unknown")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    return turns.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def common_turns(a: str, b: str) -> Column:
    """The number of leading turns with equal role and text."""
    return F.expr(
        f"if(least(size({a}), size({b})) = 0, 0, aggregate(sequence(0, least(size({a}), size({b})) - 1), 0, "
        f"(n, i) -> if(n = i and {a}[i].role = {b}[i].role and {a}[i].text = {b}[i].text, n + 1, n)))"
    )


def rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(HEAD.split("{}")[0]), t["role"], F.lit(HEAD.split("{}")[1]), t["text"], F.lit(END))))


def mask(turns: Column) -> Column:
    """array<struct<start, end>>: the character spans of the rendered turns that are learned, a learned turn's text and end."""
    extra = len(HEAD) - 2
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc, t):
        start = acc["at"] + extra + F.length(t["role"])
        end = start + F.length(t["text"]) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == LEARNED, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step)["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Renders (chosen_id, chosen, rejected_id, rejected), both sides arrays of turns.

    Returns (chosen_id, rejected_id, further columns, n_prefix, prompt, chosen, rejected,
    chosen_mask, rejected_mask). The longest common prefix of turns is the
    prompt and isn't learned; each completion is what follows on its side, and
    its mask covers the assistant's turns. Where one side is a prefix of the
    other, that completion is empty; equal conversations give two empty ones.
    """
    n = pairs.withColumn("n_prefix", common_turns("chosen", "rejected"))
    carried = [c for c in pairs.columns if c not in ("chosen", "rejected", "chosen_id", "rejected_id", "n_prefix", "head", "prompt")]
    rest = {c: F.slice(c, F.col("n_prefix") + 1, F.greatest(F.size(c) - F.col("n_prefix"), F.lit(0))) for c in ("chosen", "rejected")}
    cut = n.select("chosen_id", "rejected_id", *carried, "n_prefix", F.slice("chosen", F.lit(1), F.col("n_prefix")).alias("head"), *(e.alias(c) for c, e in rest.items()))
    return cut.select(
        "chosen_id", "rejected_id", *carried, F.col("n_prefix").cast("long").alias("n_prefix"), rendered(F.col("head")).alias("prompt"),
        *(rendered(F.col(c)).alias(c) for c in rest), *(mask(F.col(c)).alias(f"{c}_mask") for c in rest),
    )


def same_opening(convs: DataFrame) -> DataFrame:
    """(chosen_id, chosen, rejected_id, rejected): of the conversations with an equal first turn, the one with the smallest id as chosen against each other one.

    So n conversations make n - 1 pairs, and an opening that very many share is salted.
    """
    scratch = Scratch(convs.sparkSession)
    convs = convs.select("conv", "turns")
    first = convs.withColumn("opening", F.md5(F.concat_ws("\x1f", F.col("turns")[0]["role"], F.col("turns")[0]["text"])))
    first = scratch.put(first, "conversations")
    groups = first.groupBy("opening").agg(F.min("conv").alias("chosen_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    anchors = groups.join(first.select(F.col("conv").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id")
    pairs = salted_join(first, anchors, ["opening"], "conv", "n", max(first.count(), 1)).where("conv <> chosen_id")
    return pairs.select("chosen_id", "chosen", F.col("conv").alias("rejected_id"), F.col("turns").alias("rejected"))


def borrowed_reply(convs: DataFrame) -> DataFrame:
    """(chosen_id, chosen, rejected_id, rejected): each conversation against itself with the last turn's text taken from the conversation with the next id.

    The usual way to make negatives where nobody has ranked anything. A
    conversation whose next id doesn't exist makes no pair.
    """
    donor = convs.select((F.col("conv") - 1).alias("conv"), F.element_at("turns", -1)["text"].alias("reply"))
    pairs = convs.join(donor, "conv")
    last = F.element_at("turns", -1)
    swapped = F.concat(F.slice("turns", F.lit(1), F.size("turns") - 1), F.array(F.struct(last["turn"].alias("turn"), last["role"].alias("role"), F.col("reply").alias("text"))))
    return pairs.select(F.col("conv").alias("chosen_id"), F.col("turns").alias("chosen"), (F.col("conv") + 1).alias("rejected_id"), swapped.alias("rejected"))
