"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is its share of all sizes, by weight; no source gives more than `most` times its own size, and what
it can't give is shared out again by weight. Of a source, whole passes over all documents come first. For the remaining
budget the documents are counted by exact length. Each length gives its proportional number of documents, its fraction
being the seeded chance of one more; what rounding adds or leaves in words is carried on to the next shorter length, so
that documents of all lengths have the same share. What is then missing, less than a document, is filled exactly, or as
nearly as the lengths allow, by bounded-knapsack dynamic programming over the documents left and a few seeded ones that
are put back for it; and over further passes where these don't suffice. Which documents of a length are taken follows
from a seeded hash of their ids and texts.

Only counts by source and length are brought together, one row a length. The choice within a length is a rank, counted
in slices of the hash, so that no length that very many documents have is sorted in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cifra.llm.common import WORD, fresh, row_hash, settled

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 11
#: Documents, and their words, that are put back at most, so that the program has something to exchange.
PUT_BACK, PUT_BACK_WORDS = 64, 1 << 16
#: Documents of one length and slice of the hash that are ranked together.
SLICE = 1000


def size_of(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Of each source its target. Sources by code point, null last, weigh as in weights, repeating."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    own, budget, fixed = dict(order), float(sum(n for _, n in order)), {}
    while True:
        free = [s for s in own if s not in fixed]
        per_weight = (budget - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * per_weight > most * own[s]]
        if not over:
            return fixed | {s: weight[s] * per_weight for s in free}
        fixed |= {s: float(most * own[s]) for s in over}


def knapsack(lengths: np.ndarray, left: np.ndarray, budget: int) -> np.ndarray:
    """Of each length how many documents, at most left, to come as near to budget as can be without exceeding it.
    Lengths that stand first are used first."""
    pieces, total = [], 0  # (length index, documents): 1, 2, 4, ... and a rest make every number up to left
    for i, (size, count) in enumerate(zip(lengths.tolist(), left.tolist(), strict=True)):
        count, k = min(count, budget // size) if size else 0, 1
        total += size * count
        while count > 0:
            pieces.append((i, min(k, count)))
            count -= k
            k *= 2
    budget = min(budget, total)
    by = np.full(budget + 1, -1, "<i4")  # the piece with which a sum was first reached
    by[0] = len(pieces)
    for p, (i, k) in enumerate(pieces):
        step = int(lengths[i]) * k
        fresh = np.flatnonzero((by[:-step] >= 0) & (by[step:] < 0)) + step
        by[fresh] = p
        if by[budget] >= 0:
            break
    taken, at = np.zeros(len(lengths), "<i8"), int(np.flatnonzero(by >= 0)[-1])
    while at:
        i, k = pieces[by[at]]
        taken[i] += k
        at -= int(lengths[i]) * k
    return taken


def diffused(lengths: np.ndarray, counts: np.ndarray, budget: int, rng: np.random.Generator) -> np.ndarray:
    """Of each length its share of documents, for at most budget words together. From the longest down, what a length
    gives less or more than its share, in words, is added to the share of the next."""
    taken, total, chance = np.zeros(len(lengths), "<i8"), int((lengths * counts).sum()), rng.random(len(lengths))
    carry, rest, share = 0.0, budget, min(1.0, budget / total) if total else 0.0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, count = int(lengths[i]), int(counts[i])
        if size and count:
            due = count * share + carry / size
            taken[i] = n = max(0, min(int(np.floor(due + chance[i])), count, rest // size))
            carry, rest = (due - n) * size, rest - n * size
    return taken


def longest_first(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Of each length as many documents as still fit; what is left over is shorter than any document left."""
    taken = np.zeros(len(lengths), "<i8")
    for i in np.argsort(-lengths, kind="stable").tolist():
        if lengths[i]:
            taken[i] = n = min(int(counts[i]), budget // int(lengths[i]))
            budget -= n * int(lengths[i])
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, again: int = 0, seed: int = SEED) -> np.ndarray:
    """Of each length how many documents to take so that the sizes add up to budget, or nearly. Only where that can't be
    filled otherwise, documents are taken a second time or more, up to `again` times."""
    rng, lengths = np.random.default_rng(seed), lengths.astype("<i8")
    taken, most = np.zeros(len(lengths), "<i8"), np.zeros(len(lengths), "<i8")
    for passes in (1, again):
        rest = budget - int((lengths * taken).sum())
        if rest <= 0 or not passes:
            break
        most += counts * passes
        taken += diffused(lengths, most - taken, rest, rng)
        taken += longest_first(lengths, most - taken, budget - int((lengths * taken).sum()))
        back, words = np.zeros(len(lengths), "<i8"), 0
        order = rng.permutation(len(lengths))
        while back.sum() < PUT_BACK:
            some = [i for i in order.tolist() if lengths[i] and back[i] < taken[i] and words + lengths[i] <= PUT_BACK_WORDS][: PUT_BACK - int(back.sum())]
            for i in some:
                if words + lengths[i] <= PUT_BACK_WORDS:
                    back[i] += 1
                    words += int(lengths[i])
            if not some:
                break
        taken -= back
        # Those put back come first, so that of others only as many come in as the exchange needs.
        pieces = np.r_[order, order]
        limit = np.r_[back[order], (most - taken - back)[order]]
        picked = knapsack(lengths[pieces], limit, budget - int((lengths * taken).sum()))
        np.add.at(taken, pieces, picked)
    return taken


def pick_of(seed: int) -> Column:
    """A seeded hash that tells rows apart by id and text, also where ids repeat or are null."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, passes and taken of each row of docs.

    docs needs doc_id, source and text; further columns don't matter. A null text has size 0, null is a source of its
    own. Documents of size 0 are taken 0 times more than the whole passes, and count nothing. Rows that repeat a doc_id
    or have none are documents each; rows equal in id, text and source are taken in any order, which makes no
    difference in the result's rows. A source of size 0 has target 0. An empty table gives an empty result. The driver
    holds one row a source, a task the lengths of one source.
    """
    return picked(docs, weights, most, seed).drop("pick", "row")


def picked(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """The rows of mix(), with the hash by which they are chosen in pick, and one of all their columns in row."""
    sized = settled(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of().alias("size"), pick_of(seed).alias("pick"), row_hash(docs.columns).alias("row")))
    of_source = [(r["source"], r["n"] or 0) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    aims = targets(of_source, weights, most)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, n, aims[s]) for s, n in of_source], "source string, source_size long, target double")
    counts = sized.groupBy("source", "size").count()

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
        own, aim = int(pdf["source_size"].iloc[0]), pdf["target"].iloc[0]
        passes = min(int(aim // own), most) if own else 0
        more = fit(pdf["size"].to_numpy("<i8"), pdf["count"].to_numpy("<i8"), int(round(aim)) - passes * own if passes < most else 0, most - passes - 1, zlib.crc32(str(pdf["source"].iloc[0]).encode()) ^ seed)
        return pdf.assign(passes=passes, more=more)

    fits = settled(counts.join(plan, counts["source"].eqNullSafe(plan["source"])).select(counts["source"], "size", "count", "source_size", "target").groupBy("source").applyInPandas(fitted, "source string, size long, count long, source_size long, target double, passes int, more long"))
    # Slices of the hash are in its order, so a document's rank is the count of the slices before and its rank in its own.
    joined = sized.join(fits.withColumnRenamed("source", "s").withColumnRenamed("size", "n"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n"))).drop("s", "n")
    sliced = joined.withColumn("slices", F.ceil(F.col("count") / SLICE)).withColumn("slice", F.least(F.col("slices") - 1, F.floor((F.col("pick") / F.lit(2.0**64) + 0.5) * F.col("slices"))))
    key = ["source", "size"]
    before = sliced.groupBy(*key, "slice").agg(F.count("*").alias("own"), F.first("more").alias("more"))
    before = before.withColumn("before", F.sum("own").over(Window.partitionBy(*key).orderBy("slice")) - F.col("own")).select(F.col("source").alias("s"), F.col("size").alias("n"), F.col("slice").alias("k"), "before")
    placed = sliced.withColumn("rank", F.row_number().over(Window.partitionBy(*key, "slice").orderBy("pick", "doc_id")))
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n")) & (F.col("slice") == F.col("k")))
    each = F.floor(F.col("more") / F.col("count"))  # of a length taken more often than it has documents, first once each
    copies = (F.col("passes") + each + F.when(F.col("before") + F.col("rank") <= F.col("more") - each * F.col("count"), 1).otherwise(0)).cast("int")
    return placed.select("pick", "row", "doc_id", "source", "size", "source_size", "target", copies.alias("passes"), (F.col("size") * copies).alias("taken"))


def stage(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix: documents taken at least once, with their columns, how often (passes), size, source_size, target, taken.

    Rows equal in every column can't be told apart; one row stands for them, with their passes and taken words added up.
    Columns of docs named like an added one are replaced.
    """
    key, added = ["row", "doc_id", "source"], ["size", "source_size", "target", "passes", "taken"]
    own_hash, rows, *same = fresh(docs, "_hash", "_rows", *(f"_{c}" for c in key))
    mixed = picked(docs, weights, most, seed).groupBy(*key, "size", "source_size", "target").agg(F.sum("passes").cast("int").alias("passes"), F.sum("taken").alias("taken"), F.count("*").alias(rows))
    mixed = settled(mixed.filter("passes > 0").withColumnsRenamed(dict(zip(key, same, strict=True))))
    own = docs.withColumn(own_hash, row_hash(docs.columns)).drop(*added)
    equal = (F.col(own_hash) == F.col(same[0])) & F.col("doc_id").cast("long").eqNullSafe(F.col(same[1])) & F.col("source").cast("string").eqNullSafe(F.col(same[2]))
    chosen = lambda some: own.join(some, equal).drop(own_hash, rows, *same)
    out, alike = chosen(mixed.filter(F.col(rows) == 1)), mixed.filter(F.col(rows) > 1)
    return out if alike.isEmpty() else out.unionByName(chosen(alike).dropDuplicates())
