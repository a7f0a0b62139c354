"""Row operators: keep-first dedup, splits, fallback filters, seeded shuffles, sentences and number pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cifra.functions import text, verbalize


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df


def keep_first(df: DataFrame, key: Column, row_id: str) -> DataFrame:
    """The row with the smallest id of each key. min_by combines before the shuffle, so a hot key sends a row a task."""
    row = F.struct(*df.columns)
    return df.groupBy(key.alias("_key")).agg(F.min_by(row, F.col(row_id)).alias("_row")).select("_row.*")


def prefix_key(c: Column, n: int) -> Column:
    return F.substring(F.lower(c), 1, n)


def digest_key(task: Column, answer: Column) -> Column:
    return F.md5(F.concat(F.coalesce(task, F.lit("")), F.coalesce(answer, F.lit(""))).cast("binary"))


def first_rows(df: DataFrame, row_id: str, n: int) -> DataFrame:
    return df.orderBy(row_id).limit(n)


def filter_or_all(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition, or all rows if none does."""
    return df if df.filter(condition).isEmpty() else df.filter(condition)


def id_at(df: DataFrame, row_id: str, place: int, total: int, few: int = 1_000_000) -> int:
    """The smallest id that at least `place` of the `total` rows do not exceed. Approximate quantiles narrow the range
    of ids until it has few rows; only those are sorted."""
    band, before, n = df.select(row_id), 0, total
    while n > few:
        at = (place - before) / n
        low, high = band.agg(F.percentile_approx(row_id, [max(0.0, at - 0.001), min(1.0, at + 0.001)], 10_000)).first()[0]
        under, inside = band.agg(F.count_if(F.col(row_id) < low), F.count_if(F.col(row_id).between(low, high))).first()
        if low == high and under < place - before <= under + inside:
            return low
        if place - before <= under:
            band, n = band.filter(F.col(row_id) < low), under
        elif place - before > under + inside:
            band, before, n = band.filter(F.col(row_id) > high), before + under + inside, n - under - inside
        elif inside < n:
            band, before, n = band.filter(F.col(row_id).between(low, high)), before + under, inside
        else:
            break
    return band.orderBy(row_id).limit(place - before).agg(F.max(row_id)).first()[0]


def positional_split(df: DataFrame, row_id: str, share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The first floor(share * n) rows by id, and the rest, with which rows without id are. Equal ids aren't parted."""
    known = df.filter(F.col(row_id).isNotNull())
    total = known.count()
    n = int(total * share)
    if n == 0:
        return df.limit(0), df
    cut = id_at(known, row_id, n, total)
    return df.filter(F.col(row_id) <= cut), df.filter(F.col(row_id).isNull() | (F.col(row_id) > cut))


def hash_split(df: DataFrame, row_id: str, share: float = 0.9, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    first = F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return df.filter(first), df.filter(~first)


def known_rows(df: DataFrame, truth: str = "ground_truth", task: str = "task_text") -> DataFrame:
    """Rows that have an answer and a text that isn't empty."""
    return df.filter(F.col(truth).isNotNull() & (F.col(task) != ""))


def shuffled(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in a seeded order. The hash of the last one is found first, so that rows beyond it aren't sorted and no
    task gets all; rows of equal hash aren't parted."""
    rows = df.withColumn("_hash", F.xxhash64(F.col(row_id), F.lit(seed)))
    total = rows.count()
    if 0 < n < total:
        rows = rows.filter(F.col("_hash") <= id_at(rows, "_hash", n, total))
    return rows.filter(F.lit(n > 0)).orderBy("_hash", row_id).drop("_hash")


def sentences(df: DataFrame, column: str, row_id: str, after_stops: bool = True) -> DataFrame:
    cut = text.sentences_after_stops if after_stops else text.sentences_by_stops
    return df.select(F.col(row_id).alias("row"), F.posexplode(cut(F.col(column))).alias("pos", "sentence"))


def number_sentences(df: DataFrame, column: str, row_id: str, least: int = 15, most: int | None = None, cut: int = 300) -> DataFrame:
    found = sentences(df, column, row_id).filter(text.has_number(F.col("sentence"), least, most))
    return found.withColumn("sentence", F.substring("sentence", 1, cut))


def first_number_pairs(df: DataFrame, column: str, n: int = 2) -> DataFrame:
    """A row for each of the first n numbers of a text but zero: the number, and the text with its first occurrence in words."""
    numbers = F.slice(F.regexp_extract_all(F.col(column), F.lit("(?U)\\b(\\d{1,6})\\b"), F.lit(1)), 1, n)
    rows = df.withColumn("number", F.explode(numbers)).filter(F.col("number").cast("long") != 0)
    at = F.instr(F.col(column), F.col("number"))
    words = verbalize.number_to_words(F.col("number").cast("long"))
    return rows.withColumn("task_text", F.concat(F.substr(F.col(column), F.lit(1), at - 1), words, F.substr(F.col(column), at + F.char_length("number"))))


def spoken_pairs(df: DataFrame, column: str, row_id: str, most_digits: int = 6) -> DataFrame:
    """task_text and ground_truth from the lower-cased, space-collapsed text and its first number of up to most_digits
    digits (one that has no words stays in digits); equal pairs once."""
    truth = text.collapsed(F.lower(F.col(column)))
    number = f"\\b(\\d{{1,{most_digits}}})\\b"
    found = df.select(F.col(row_id), truth.alias("ground_truth")).withColumn("number", F.regexp_extract("ground_truth", f"(?U){number}", 1)).filter("number <> ''")
    parts = [F.regexp_extract("ground_truth", f"(?sU)^(.*?){number}(.*)$", i) for i in (1, 3)]
    words = F.coalesce(verbalize.number_to_words(F.expr("try_cast(number AS BIGINT)"), few_millions=False), F.col("number"))
    made = found.withColumn("task_text", F.concat(parts[0], words, parts[1]))
    return keep_first(made, digest_key(F.col("task_text"), F.col("ground_truth")), row_id).select(row_id, "task_text", "ground_truth")
