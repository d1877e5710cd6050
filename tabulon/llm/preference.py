"""Preference formatting: chosen and rejected conversations to one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as structs of role and text.

    Turns of equal number are ordered by role, then text; null role or text counts as empty, a null conv_id is an
    id like any other, and repeated rows are turns of their own.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def swapped_reply_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): each conversation as chosen; as rejected, the same with its last assistant
    turn replaced by that of its neighbour (conv_id with the lowest bit flipped, also below 0), empty where there
    is none.

    A conversation without an assistant turn gets the neighbour's reply at its end; one without an id has no
    neighbour; no conversations give no pairs.
    """
    convs = turn_arrays(conversations).withColumn("pair", F.shiftright("conv_id", 1))
    replies = F.filter("turns", lambda t: t["role"] == "assistant")
    convs = convs.withColumn("reply", F.coalesce(F.try_element_at(replies, F.lit(-1))["text"], F.lit("")))
    replaced = F.size("turns") - F.coalesce(F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), "assistant"), F.lit(0)) + 1
    convs = convs.withColumn("at", F.when(F.exists("turns", lambda t: t["role"] == "assistant"), replaced).otherwise(F.size("turns") + 1).cast("int"))
    other = convs.select(F.col("pair").alias("p2"), F.col("conv_id").alias("c2"), F.col("reply").alias("other_reply"))
    joined = convs.join(other, (F.col("pair") == F.col("p2")) & (F.col("conv_id") != F.col("c2")), "left")
    new = F.struct(F.lit("assistant").alias("role"), F.coalesce("other_reply", F.lit("")).alias("text"))
    rejected = F.concat(F.slice("turns", F.lit(1), F.col("at") - 1), F.array(new), F.slice("turns", F.col("at") + 1, F.greatest(F.size("turns") - F.col("at"), F.lit(0))))
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def _turn_text(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn_text), "")


def _mask(turns: Column) -> Column:
    """``start:end`` of what is trained on (text and end mark of assistant turns), joined by commas, in code
    points of the completion, end exclusive."""
    head = lambda t: F.length(t["role"]) + 5
    return F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(_turn_text(t))).alias("at"),
            F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(F.concat_ws(":", a["at"] + head(t), a["at"] + head(t) + F.length(t["text"]) + 7)))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: F.array_join(a["spans"], ","),
    )


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask``.

    ``pairs`` has ``chosen`` and ``rejected``: arrays of (role, text).  The longest common prefix of turns is
    rendered once as ``prompt``; what follows on either side is its completion.  Equal conversations leave
    two empty completions; a null side counts as one without turns.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    clean = lambda c: F.transform(F.coalesce(F.col(c), none), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    df = pairs.select("pair_id", clean("chosen").alias("c"), clean("rejected").alias("r"))
    both = F.least(F.size("c"), F.size("r"))
    steps = F.when(both > 0, F.sequence(F.lit(1), both)).otherwise(F.array().cast("array<int>"))
    differ = F.array_min(F.filter(steps, lambda i: F.element_at("c", i) != F.element_at("r", i)))
    df = df.withColumn("n", F.coalesce(differ - 1, both).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    return df.select(
        "pair_id", F.col("n").alias("prompt_turns"), _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest("c")).alias("chosen"), _mask(rest("c")).alias("chosen_mask"), _render(rest("r")).alias("rejected"), _mask(rest("r")).alias("rejected_mask"),
    )
