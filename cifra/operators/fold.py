"""The number-group fold: one expression for both parsers, over tokens that carry their classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cifra.functions.lexicon import MULTIPLIER, ORDINAL
from cifra.functions.text import let

STATE = "struct<open:boolean,compound:bigint,now:bigint,last:int,last_mult:int,out:array<string>>"


def rewritten(items: Column, sequence: bool) -> Column:
    """array<string>: items with each maximal group of numbers replaced by its totals.

    items: array<struct<raw, v, m, k, num, held>>: a word (num false) or a part of a number word. held marks a word that
    begins no group, though it may go on in one. A group's parts add while magnitudes fall, multiply at a multiplier,
    and begin a new total when a magnitude comes again or the next part belongs elsewhere.
    """
    joined = let(items, lambda all_of: F.transform(all_of, lambda x, i: F.struct(x.alias("x"), F.get(all_of, i + 1).alias("next"))))

    def state(open_: Column, compound: Column, now: Column, last: Column, last_mult: Column, out: Column) -> Column:
        return F.struct(open_, compound, now, last, last_mult, out).cast(STATE)

    def total(s: Column) -> Column:
        return F.array((s["compound"] + s["now"]).cast("string"))

    def step(s: Column, t: Column) -> Column:
        x, nxt = t["x"], t["next"]
        yes, none, zero = F.lit(True), F.lit(-1), F.lit(0).cast("bigint")
        product = F.when(s["now"] > 0, s["now"] * x["v"]).otherwise(x["v"])
        again = x["m"] == s["last_mult"]
        multiplied = state(yes, F.when(again, product).otherwise(s["compound"] + product), zero, none, x["m"], F.when(again, F.concat(s["out"], F.array(s["compound"].cast("string")))).otherwise(s["out"]))
        follows = (nxt["k"] == 0) & (nxt["m"] <= 1) if sequence else nxt["m"] == x["m"]
        parts = F.coalesce((x["m"] <= 1) & nxt["num"] & follows, F.lit(False))
        begun = state(yes, s["compound"], x["v"], x["m"], s["last_mult"], s["out"])
        added = state(yes, s["compound"], s["now"] + x["v"], x["m"], s["last_mult"], s["out"])
        restarted = state(yes, zero, x["v"], x["m"], none, F.concat(s["out"], total(s)))
        number = F.when(x["k"] == MULTIPLIER, multiplied).when(s["last"] == -1, begun).when((x["m"] < s["last"]) & ~parts, added).otherwise(restarted)
        word = state(F.lit(False), zero, zero, none, none, F.concat(s["out"], F.when(s["open"], total(s)).otherwise(F.array().cast("array<string>")), F.array(x["raw"])))
        return F.when(x["num"] & (s["open"] | ~x["held"]), number).otherwise(word)

    start = F.struct(F.lit(False), F.lit(0), F.lit(0), F.lit(-1), F.lit(-1), F.array()).cast(STATE)
    return F.aggregate(joined, start, step, lambda s: F.when(s["open"], F.concat(s["out"], total(s))).otherwise(s["out"]))


def parse_group(parts: Column, sequence: bool) -> Column:
    """array<string>: the totals of a group given as array<struct<v bigint, m int, k int>>. Vague parts are left out before."""
    return rewritten(F.transform(parts, lambda p: F.struct(F.lit("").alias("raw"), p["v"].alias("v"), p["m"].alias("m"), p["k"].alias("k"), F.lit(True).alias("num"), F.lit(False).alias("held"))), sequence)


def legacy_parts(parts: Column) -> Column:
    """Parts from array<struct<val, mag, is_mult, is_ordinal>>."""
    return F.transform(parts, lambda p: F.struct(p["val"].cast("bigint").alias("v"), p["mag"].cast("int").alias("m"), F.when(p["is_mult"], MULTIPLIER).when(p["is_ordinal"], ORDINAL).otherwise(0).alias("k")))
