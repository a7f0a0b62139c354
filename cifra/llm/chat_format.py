"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation, rendered once as the
prompt, and the two remainders as completions with their loss masks. Where only conversations are there, other_replies()
makes rejected ones of them, which share all turns up to the last reply.

A turn is rendered as `<|role|>`, a line feed, its text, `<|end|>` and a line feed. `<|` in a text becomes `< |`, so no
text can forge a marker. The mask of a completion lists the character spans (start-end, end exclusive) that count for
the loss: the text and end marker of assistant turns. Turns are equal when role and text are; null equals null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def role_of(turn: Column) -> Column:
    return F.coalesce(turn["role"], F.lit("unknown"))


def body_of(turn: Column) -> Column:
    return F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |"))


def head_of(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.replace(role_of(turn), F.lit("<|"), F.lit("< |")), F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head_of(t), body_of(t), F.lit(END))), "")


def masked(turns: Column) -> Column:
    """The loss spans of rendered(turns), comma-joined."""
    pieces = F.transform(turns, lambda t: F.struct(F.char_length(head_of(t)).alias("head"), (F.char_length(body_of(t)) + len(END)).alias("tail"), (role_of(t) == "assistant").alias("counts")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(done: Column, p: Column) -> Column:
        begin = done["at"] + p["head"]
        span = F.concat(begin.cast("string"), F.lit("-"), (begin + p["tail"]).cast("string"))
        return F.struct((begin + p["tail"]).alias("at"), F.when(p["counts"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    return F.array_join(F.aggregate(pieces, start, step)["spans"], ",")


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns both begin with."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int")


def gathered(turns: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id and the turns of both sides, c and r, in order.

    turns has a row a turn: pair_id, is_chosen, conv_id, turn, role, text; further columns don't matter. Turns go by
    their number, null first, equal numbers by role and text; repeated rows are turns each. A missing side is empty. A
    turn without pair_id belongs to no other, and is a pair of its own without id, however many there are. If one side
    of a pair has several conv_ids, the smallest is reported and all its turns count.
    """
    one = F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    lone = F.when(F.col("pair_id").isNull(), F.monotonically_increasing_id())  # tells turns without pair_id apart
    own = turns.filter("is_chosen is not null").withColumn("lone", lone).groupBy("pair_id", "lone").agg(
        F.min(F.when(F.col("is_chosen"), F.col("conv_id"))).alias("chosen_id"),
        F.min(F.when(~F.col("is_chosen"), F.col("conv_id"))).alias("rejected_id"),
        F.sort_array(F.collect_list(F.when(F.col("is_chosen"), one))).alias("c"),
        F.sort_array(F.collect_list(F.when(~F.col("is_chosen"), one))).alias("r"),
    )
    return own.drop("lone")


def formatted(pairs: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask of each row
    of gathered(), or of any pairs with such columns."""
    cut = pairs.withColumn("k", common_turns(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(side, F.col("k") + 1, F.greatest(F.size(side) - F.col("k"), F.lit(0)))
    cut = cut.withColumn("prompt_turns", F.slice("c", F.lit(1), F.col("k"))).withColumn("c", rest(F.col("c"))).withColumn("r", rest(F.col("r")))
    return cut.select("pair_id", "chosen_id", "rejected_id", F.col("k").cast("long").alias("n_prompt_turns"), rendered(F.col("prompt_turns")).alias("prompt"), rendered(F.col("c")).alias("chosen"), masked(F.col("c")).alias("chosen_mask"), rendered(F.col("r")).alias("rejected"), masked(F.col("r")).alias("rejected_mask"))


def preferences(turns: DataFrame) -> DataFrame:
    """formatted() of gathered() turns: see there for what turns holds.

    A null text is empty, a null role is "unknown". Of an empty side nothing is common and its completion is empty. An
    empty table gives an empty result. A pair is one row, so its conversations must fit a task.
    """
    return formatted(gathered(turns))


def neighbours(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as chosen and rejected of pair k; a turn without conv_id is the chosen side of a pair without id."""
    number = F.col("conv_id").cast("long")
    return conversations.select(F.floor(number / 2).cast("long").alias("pair_id"), F.coalesce(F.pmod(number, F.lit(2)) == 0, F.lit(True)).alias("is_chosen"), number.alias("conv_id"), "turn", "role", "text")


def last_reply(turns: Column) -> Column:
    """The place, from 1, of the last assistant turn; 0 if there is none."""
    return F.array_max(F.concat(F.array(F.lit(0)), F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0))))


def other_replies(pairs: DataFrame) -> DataFrame:
    """Of each pair of gathered() two pairs, each conversation with itself: the rejected one has the other
    conversation's last assistant text as its own last assistant turn, or an empty one if the other has none.

    pair_id and chosen_id are the conversation's, rejected_id is that of the other. A conversation without an assistant
    turn is the same on both sides, so all of it is prompt. An empty side gives no pair.
    """

    def against(own: str, own_id: str, other: str, other_id: str) -> Column:
        a, b = F.col(own), F.col(other)
        reply = F.when(last_reply(b) > 0, F.get(b, last_reply(b) - 1)["text"]).otherwise(F.lit(""))
        changed = F.transform(a, lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i + 1 == last_reply(a), reply).otherwise(t["text"]).alias("text")))
        return F.struct(F.col(own_id).alias("pair_id"), F.col(own_id).alias("chosen_id"), F.col(other_id).alias("rejected_id"), a.alias("c"), changed.alias("r"))

    both = F.array(against("c", "chosen_id", "r", "rejected_id"), against("r", "rejected_id", "c", "chosen_id"))
    return pairs.select(F.inline(F.filter(both, lambda p: F.size(p["c"]) > 0)))
