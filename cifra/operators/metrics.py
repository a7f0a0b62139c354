"""Evaluation and report aggregates. Each is one aggregate over its input; none brings rows to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cifra.functions import lexicon, text

Col = Column


def numeral_words(c: Col) -> Col:
    """How many tokens of a text are number words of the current mode. All of these are Cyrillic, so a text without such
    a letter isn't cut into tokens."""
    known = lambda t: lexicon.lookup(F.lower(t)).isNotNull() | ((F.regexp_extract(F.lower(t), lexicon.fused_pattern(), 1) != "") & lexicon.root_lookup(F.regexp_extract(F.lower(t), lexicon.fused_pattern(), 1)).isNotNull())
    return F.when(F.regexp_like(c, F.lit("[\u0400-\u04ff]")), F.size(F.filter(text.tokens(c), known))).otherwise(0)


def text_stats(c: Col) -> Col:
    c = F.coalesce(c, F.lit(""))
    return F.struct(F.char_length(c).alias("length"), F.size(text.tokens(c)).alias("tokens"), text.count_numbers(c).alias("digit_tokens"), numeral_words(c).alias("numeral_words"))


def run_report(df: DataFrame, column: str = "answer") -> DataFrame:
    s = df.select(text_stats(F.col(column)).alias("s"))
    return s.agg(F.count("*").alias("n_rows"), F.count_if(F.col("s.digit_tokens") > 0).alias("rows_with_digits"), F.sum("s.digit_tokens").alias("digits"), F.sum("s.numeral_words").alias("numeral_words"), F.avg("s.digit_tokens").alias("avg_digits"), F.min("s.tokens").alias("min_tokens"), F.avg("s.tokens").alias("avg_tokens"), F.max("s.tokens").alias("max_tokens"))


def accuracy(df: DataFrame, truth: str = "ground_truth", predicted: str = "answer") -> DataFrame:
    """correct, total and percent of equal rows (null equals null); the percent of no rows is null."""
    return df.agg(F.count_if(F.col(truth).eqNullSafe(F.col(predicted))).alias("correct"), F.count("*").alias("total")).withColumn("pct", F.when(F.col("total") > 0, 100.0 * F.col("correct") / F.col("total")))


def accuracy_by(df: DataFrame, by: str, truth: str = "ground_truth", predicted: str = "answer") -> DataFrame:
    """The same overall (null) and for each value of a column, in one rollup of all rows; those whose value is null count in the overall row and have none of their own."""
    rows = df.rollup(by).agg(F.count_if(F.col(truth).eqNullSafe(F.col(predicted))).alias("correct"), F.count("*").alias("total"), F.grouping_id().alias("_level"))
    rows = rows.filter((F.col("_level") == 1) | F.col(by).isNotNull()).drop("_level")
    return rows.withColumn("pct", 100.0 * F.col("correct") / F.col("total"))


def evaluate_report(df: DataFrame, truth: str = "ground_truth", predicted: str = "answer") -> DataFrame:
    """accuracy with the number totals of both sides, and what one has less or more than the other, row by row. The rows
    that are wrong are those of errors(), of which a report shows three."""
    g, p = text.count_numbers(F.coalesce(F.col(truth), F.lit(""))), text.count_numbers(F.coalesce(F.col(predicted), F.lit("")))
    right = F.col(truth).eqNullSafe(F.col(predicted))
    return df.agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), F.count_if(~right).alias("wrong"), F.sum(g).alias("gold_numbers"), F.sum(p).alias("predicted_numbers"), F.sum(F.greatest(g - p, F.lit(0))).alias("missed"), F.sum(F.greatest(p - g, F.lit(0))).alias("extra"))


def errors(df: DataFrame, row_id: str, n: int = 15, truth: str = "ground_truth", predicted: str = "answer") -> DataFrame:
    """The first n rows that differ, by row id."""
    return df.filter(~F.col(truth).eqNullSafe(F.col(predicted))).orderBy(row_id).limit(n)


def error_class(task: Col, truth: Col, predicted: Col) -> Col:
    """grouping: token counts differ from the task's on both sides; then numbers missing, extra, other. Null: no error."""
    size = lambda c: text.space_parts(c)
    gold, got = F.array_distinct(text.digit_runs(truth)), F.array_distinct(text.digit_runs(predicted))
    kind = F.when((size(task) != size(truth)) & (size(task) != size(predicted)), "grouping").when(F.size(F.array_except(gold, got)) > 0, "missing").when(F.size(F.array_except(got, gold)) > 0, "extra").otherwise("other")
    return F.when(~truth.eqNullSafe(predicted), kind)


def error_taxonomy(df: DataFrame, task: str = "task_text", truth: str = "ground_truth", predicted: str = "answer") -> DataFrame:
    """How many errors of each class, the most frequent class first."""
    return df.withColumn("error_class", error_class(F.col(task), F.col(truth), F.col(predicted))).filter("error_class is not null").groupBy("error_class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_class")


def positional_errors(truth: Col, predicted: Col) -> Col:
    """Places at which two texts differ over their common length, plus the difference in length."""
    a, b = F.split(truth, ""), F.split(predicted, "")
    a, b = F.when(truth == "", F.array().cast("array<string>")).otherwise(a), F.when(predicted == "", F.array().cast("array<string>")).otherwise(b)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return F.greatest(F.char_length(truth), F.char_length(predicted)) - same


def character_error_rate(df: DataFrame, truth: str = "ground_truth", predicted: str = "answer") -> DataFrame:
    t, p = F.coalesce(F.col(truth), F.lit("")), F.coalesce(F.col(predicted), F.lit(""))
    return df.agg(F.sum(positional_errors(t, p)).alias("errors"), F.sum(F.greatest(F.char_length(t), F.char_length(p))).alias("characters")).withColumn("cer", F.when(F.col("characters") > 0, F.round(F.col("errors") / F.col("characters"), 6)))


def number_accuracy(df: DataFrame, truth: str = "ground_truth", predicted: str = "answer") -> DataFrame:
    """Numbers that agree place by place, over all gold numbers."""
    t, p = text.digit_runs(F.coalesce(F.col(truth), F.lit(""))), text.digit_runs(F.coalesce(F.col(predicted), F.lit("")))
    right = F.size(F.filter(F.zip_with(t, p, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return df.agg(F.sum(right).alias("right_numbers"), F.sum(F.size(t)).alias("gold_numbers")).withColumn("number_accuracy", F.when(F.col("gold_numbers") > 0, F.round(F.col("right_numbers") / F.col("gold_numbers"), 6)))


def length_bucket(c: Col) -> Col:
    n = F.char_length(c)
    return F.when(n <= 20, "1-20").when(n <= 40, "21-40").otherwise("41+")


def accuracy_by_length(df: DataFrame, task: str = "task_text", truth: str = "ground_truth", predicted: str = "answer") -> DataFrame:
    return df.groupBy(length_bucket(F.col(task)).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col(truth).eqNullSafe(F.col(predicted))).alias("correct"))


def digit_confusion(df: DataFrame, truth: str = "ground_truth", predicted: str = "answer") -> DataFrame:
    """How often a gold number of so many digits met a predicted one of so many, place by place."""
    pairs = F.arrays_zip(text.digit_runs(F.col(truth)).alias("t"), text.digit_runs(F.col(predicted)).alias("p"))
    cells = df.select(F.explode(pairs).alias("x")).filter("x.t is not null and x.p is not null")
    return cells.groupBy(F.char_length("x.t").alias("true_digits"), F.char_length("x.p").alias("predicted_digits")).agg(F.count("*").alias("n"))


def confusion_matrix(cells: DataFrame) -> DataFrame:
    """digit_confusion() as a table with a column for each predicted length there is."""
    return cells.groupBy("true_digits").pivot("predicted_digits").agg(F.sum("n"))


def classification_report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each length, from the cells of digit_confusion()."""
    gold = cells.groupBy(F.col("true_digits").alias("digits")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true_digits") == F.col("predicted_digits"), F.col("n")).otherwise(0)).alias("hits"))
    got = cells.groupBy(F.col("predicted_digits").alias("digits")).agg(F.sum("n").alias("predicted"))
    both = gold.join(got, "digits", "full").na.fill(0, ["support", "hits", "predicted"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    both = both.withColumn("precision", share(F.col("hits"), F.col("predicted"))).withColumn("recall", share(F.col("hits"), F.col("support")))
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return both.select("digits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"), F.col("support").cast("long").alias("support"))


def digit_length_distribution(df: DataFrame, column: str) -> DataFrame:
    runs = df.select(F.explode(text.digit_runs(F.col(column))).alias("d")).groupBy(F.char_length("d").alias("digits")).agg(F.count("*").alias("n"))
    return runs.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def numbers_per_row(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(text.count_numbers(F.col(column)).alias("numbers")).agg(F.count("*").alias("n"))


def with_numbers(df: DataFrame, column: str) -> DataFrame:
    n = text.count_numbers(F.col(column))
    return df.agg(F.count_if(n > 0).alias("with_numbers"), F.count_if(n == 0).alias("without_numbers"), F.round(F.avg(n), 6).alias("avg_numbers"))


def length_correlation(df: DataFrame, column: str) -> DataFrame:
    """Correlation of tokens and numbers of a text, and the line through them."""
    x, y = text.space_parts(F.col(column)).cast("double"), text.count_numbers(F.col(column)).cast("double")
    return df.agg(F.round(F.corr(x, y), 6).alias("corr"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"))


def describe_lengths(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Count, mean, sample and population deviation, and quartiles of the byte length, and the mean of tokens."""
    n, tokens = F.octet_length(F.col(column)), text.space_parts(F.col(column))
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(F.count(n).alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("std"), F.round(F.stddev_pop(n), 6).alias("std_pop"), F.min(n).alias("min"), F.percentile(n, 0.25).alias("p25"), F.percentile(n, 0.5).alias("p50"), F.percentile(n, 0.75).alias("p75"), F.max(n).alias("max"), F.round(F.avg(tokens), 6).alias("mean_tokens"), F.round(F.stddev_samp(tokens), 6).alias("std_tokens"))


def changed(df: DataFrame, task: str = "task_text", truth: str = "ground_truth") -> DataFrame:
    """Rows whose text changed, and those whose number of tokens did."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(task) != F.col(truth)).alias("changed"), F.count_if(text.space_parts(F.col(task)) != text.space_parts(F.col(truth))).alias("regrouped"))


def regrouped_rows(df: DataFrame, row_id: str, n: int = 10, task: str = "task_text", truth: str = "ground_truth") -> DataFrame:
    """The first n rows whose texts have different numbers of tokens, by row id."""
    return df.filter(text.space_parts(F.col(task)) != text.space_parts(F.col(truth))).orderBy(row_id).limit(n)


def length_delta(df: DataFrame, truth: str = "ground_truth", predicted: str = "answer") -> DataFrame:
    """How much longer, in characters, answers are than the truth on average, and how far off either way; null texts are empty."""
    delta = F.char_length(F.coalesce(F.col(predicted), F.lit(""))) - F.char_length(F.coalesce(F.col(truth), F.lit("")))
    return df.agg(F.round(F.avg(delta), 6).alias("mean_delta"), F.round(F.avg(F.abs(delta)), 6).alias("mean_distance"), F.min(delta).alias("min_delta"), F.max(delta).alias("max_delta"))


def distortion_frequency(df: DataFrame, column: str, row_id: str, n: int = 20) -> DataFrame:
    """The n most frequent distorted words; of equal counts the one seen first."""
    known = F.array(*map(F.lit, lexicon.distorted()))
    words = df.select(F.col(row_id).alias("row"), F.posexplode(F.filter(text.tokens(F.lower(F.col(column))), lambda t: F.array_contains(known, t))).alias("pos", "word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("first")).orderBy(F.desc("n"), "first").limit(n).select("word", "n")


def ordinal_tokens(df: DataFrame, column: str, row_id: str) -> DataFrame:
    words = df.select(F.col(row_id).alias("row"), F.posexplode(text.tokens(F.col(column))).alias("pos", "word"))
    return words.filter(F.get(lexicon.lookup(F.lower("word"))["seq"], F.lit(0))["k"] == lexicon.ORDINAL)


def ordinal_report(df: DataFrame, column: str, row_id: str, n: int = 10) -> DataFrame:
    """How many ordinal tokens there are, and the first n in order of rows and places."""
    found = ordinal_tokens(df, column, row_id)
    first = [r["word"] for r in found.orderBy("row", "pos").limit(n).collect()]
    return found.agg(F.count("*").alias("n")).withColumn("first_words", F.array(*map(F.lit, first)).cast("array<string>"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
