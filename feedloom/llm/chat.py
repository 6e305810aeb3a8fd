"""Preference examples: shared turns once as prompt, the rest as a pair of masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import successors

# fixed values: the markers around a turn
TURN_START, ROLE_END, TURN_END = "<|im_start|>", "\n", "<|im_end|>\n"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(TURN_START), turn["role"], F.lit(ROLE_END), turn["text"], F.lit(TURN_END))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column, trained_role: str) -> Column:
    """Run lengths over the rendered text, as flag x code points: 1 for turns that bear loss."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.when(t["role"] == trained_role, "1").otherwise("0"), F.lit("x"), F.length(_rendered(t)))), ","
    )


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation, as (role, text) in order of turn, role and text.

    A conversation is one training record and has to fit into a row. Null roles and texts count as
    empty, null turn numbers come first, exact repeats stay. Rows without conv_id are one conversation.
    """
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("all")).select(
        "conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def preference_examples(pairs: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """pairs with arrays of turns `chosen` and `rejected` -> the same columns with prompt, completions and masks.

    shared_turns is the length of the longest common prefix of whole turns. The prompt bears no
    loss; of the completions, the turns of trained_role do. Null arrays count as empty, alike
    conversations have empty completions. Other columns are kept.
    """
    chosen, rejected = (F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>")) for c in ("chosen", "rejected"))
    same = F.zip_with(chosen, rejected, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, False)
    counted = pairs.withColumns({
        "__chosen": chosen, "__rejected": rejected,
        "shared_turns": F.when(differs > 0, differs - 1).otherwise(F.size(same).cast("long")),
    })
    rest = [F.slice(F.col(c), F.col("shared_turns").cast("int") + 1, F.size(c)) for c in ("__chosen", "__rejected")]
    prompt = F.slice(F.col("__chosen"), F.lit(1), F.col("shared_turns").cast("int"))
    return counted.withColumns({
        "prompt": _text(prompt), "chosen": _text(rest[0]), "rejected": _text(rest[1]),
        "chosen_mask": _mask(rest[0], trained_role), "rejected_mask": _mask(rest[1], trained_role),
    }).drop("__chosen", "__rejected")


def drifted_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, rejected_id, chosen, rejected): each conversation against one that drifts off halfway.

    The tables have no preference labels. The rejected conversation takes the first half of the
    turns (rounded down) and goes on with those that the next conversation in order of conv_id has
    beyond that number; the last is followed by the first. A conversation without id has no next.
    """
    lists = turn_lists(turns)
    following = successors(turns.select("conv_id"), "conv_id", "rejected_id")
    other = lists.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("other"))
    half = F.floor(F.size("turns") / 2).cast("int")
    joined = lists.join(following, "conv_id", "left").join(other, "rejected_id", "left")
    beyond = F.when(F.size("other") > half, F.slice("other", half + 1, F.size("other"))).otherwise(F.slice("turns", 1, 0))
    return joined.select(
        "conv_id", "rejected_id", F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), half), F.coalesce(beyond, F.slice("turns", 1, 0))).alias("rejected"),
    )
