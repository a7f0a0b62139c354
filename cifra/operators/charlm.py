"""Character n-gram language model as count tables."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cifra.operators.relational import id_at

START, END = "\u0002", "\u0003"


def ngrams(df: DataFrame, column: str, order: int) -> DataFrame:
    """df with `context` and `token` of every place of the padded text."""
    padded: Column = F.concat(F.lit(START * (order - 1)), F.col(column), F.lit(END))
    places = F.sequence(F.lit(1), F.char_length(F.col(column)) + 1)
    grams = F.transform(places, lambda i: F.struct(F.substr(padded, i, F.lit(order - 1)).alias("context"), F.substr(padded, i + order - 1, F.lit(1)).alias("token")))
    return df.filter(F.col(column).isNotNull()).withColumn("_gram", F.explode(grams)).select(*df.columns, "_gram.*")


@dataclass
class CharModel:
    order: int
    k: float
    grams: DataFrame  # context, token, n
    contexts: DataFrame  # context, n
    vocabulary: int
    n_train: int | None = None
    limits: dict[str, float] = field(default_factory=dict)  # thresholds by name

    def score(self, df: DataFrame, column: str, row_id: str) -> DataFrame:
        """row_id and the mean log probability of a text's characters. Grams are counted per text before the joins."""
        rows = ngrams(df.select(row_id, column), column, self.order).groupBy(row_id, "context", "token").agg(F.count("*").alias("times"))
        joined = rows.join(self.grams, ["context", "token"], "left").join(self.contexts.withColumnRenamed("n", "total"), "context", "left")
        p = (F.coalesce("n", F.lit(0)) + self.k) / (F.coalesce("total", F.lit(0)) + self.k * self.vocabulary)
        return joined.groupBy(row_id).agg((F.sum(F.ln(p) * F.col("times")) / F.sum("times")).alias("score"))

    def save(self, path: str) -> None:
        self.grams.write.mode("overwrite").parquet(f"{path}/grams")
        row = (self.order, self.k, self.vocabulary, self.n_train, self.limits)
        self.grams.sparkSession.createDataFrame([row], "n_order int, k double, vocabulary long, n_train long, limits map<string,double>").write.mode("overwrite").parquet(f"{path}/scalars")


def from_counts(grams: DataFrame, order: int, k: float, n_train: int | None = None) -> CharModel:
    contexts = grams.groupBy("context").agg(F.sum("n").alias("n"))
    letters = grams.select(F.explode(F.concat(F.array("token"), F.split("context", ""))).alias("c")).filter("c <> ''")
    return CharModel(order, k, grams, contexts, letters.distinct().count(), n_train)


def train(df: DataFrame, column: str, order: int = 3, k: float = 0.01) -> CharModel:
    return from_counts(ngrams(df.select(column), column, order).groupBy("context", "token").agg(F.count("*").alias("n")), order, k, df.filter(F.col(column).isNotNull()).count())


def load(spark: SparkSession, path: str) -> CharModel:
    order, k, vocabulary, n_train, limits = spark.read.parquet(f"{path}/scalars").first()
    grams = spark.read.parquet(f"{path}/grams")
    return CharModel(order, k, grams, grams.groupBy("context").agg(F.sum("n").alias("n")), vocabulary, n_train, dict(limits or {}))


def percentile(scores: DataFrame, share: float, n: int) -> float | None:
    """The exact percentile of n scores, between two neighbours in proportion; their places are cut out, so that no task
    holds all scores."""
    if not n:
        return None
    at = share * (n - 1)
    low, high = (id_at(scores, "score", place + 1, n) for place in (math.floor(at), math.ceil(at)))
    return low + (at - math.floor(at)) * (high - low)


def thresholds(scores: DataFrame) -> DataFrame:
    """p5, p10, min, mean and population deviation of the scores; nulls don't count, and of none all are null."""
    known = scores.select(F.col("score").cast("double")).filter("score is not null")
    n = known.count()
    cut = [F.lit(percentile(known, share, n)).cast("double").alias(name) for share, name in ((0.05, "p5"), (0.1, "p10"))]
    return known.agg(*cut, F.min("score").alias("min"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def plausible(scores: DataFrame, p5: float) -> DataFrame:
    return scores.withColumn("plausible", F.col("score") >= p5)
