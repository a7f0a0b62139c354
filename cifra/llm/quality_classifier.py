"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A document becomes a few statistics of its text. Scaled by their mean and deviation over all documents they pass through
random cosines, whose inner products approximate a Gaussian kernel. Each partition sums its part of the normal
equations, the parts are summed row by row on the cluster, and the driver solves one system of fixed size. Scores of
labelled documents kept apart from that fit are counted in bins, and an isotonic curve through the bins makes
probabilities of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cifra.llm.calibration import isotonic
from cifra.llm.common import settled, short_batches, text_bytes
from cifra.llm.quality_rules import in_repeats, word_numbers

COSINES = 256
BANDWIDTH = 3.0
RIDGE = 1e-3
SEED = 29
BINS = 400
NOISY = re.compile(rb"(?:[#*$%&|<>]|!!)(?![^\x20\x09-\x0D])")
UPPER, LETTERS, DIGITS, STOPS = rb"ABCDEFGHIJKLMNOPQRSTUVWXYZ", rb"abcdefghijklmnopqrstuvwxyz", rb"0123456789", rb".,;:!?"
STATISTICS = ("log_words", "word_length", "upper", "digits", "stops", "noisy", "distinct", "repeated", "copied_lines", "line_length", "bars", "beyond_ascii", "longest_word", "other")


def statistics(data: bytes) -> list[float]:
    """The statistics of a text; of an empty one, zeros."""
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, joined = len(words), b"".join(words)
    size, lines = len(joined), [x for x in data.split(b"\n") if x.strip()]
    by = lambda chars: size - len(joined.translate(None, chars))
    upper, lower, digits, stops = map(by, (UPPER, LETTERS, DIGITS, STOPS))
    ascii_size = len(joined.decode("utf-8", "replace").encode("ascii", "ignore"))
    return [
        np.log(n), size / n, upper / size, digits / size, stops / n, len(NOISY.findall(data)) / n, len(set(words)) / n**0.8, in_repeats(word_numbers(words), 4) / n,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), data.count(b"|") / n, 1 - ascii_size / size, np.log(max(map(len, words))), (ascii_size - upper - lower - digits - stops) / size,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row of docs."""
    short_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in rows.T)], names=["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(each, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


class Cosines:
    """The random features; the same for the same seed everywhere."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, n: int, bandwidth: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.directions, self.phases = rng.normal(0, 1 / bandwidth, (len(mean), n)), rng.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6) @ self.directions + self.phases
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])


def fold() -> F.Column:
    """crc32 of the id as text, modulo 3; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3).cast("int")


def fit(labelled: DataFrame, cosines: Cosines, ridge: float) -> np.ndarray:
    """The weights of the ridge regression on rows with the statistics and a label."""
    n = len(cosines.phases) + 1

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n + 2))
        for pdf in batches:
            x = cosines(pdf[list(STATISTICS)].to_numpy(float))
            total += x.T @ np.hstack([x, pdf[["label"]].to_numpy(float), np.ones((len(x), 1))])
        yield pd.DataFrame({"i": range(n), "sums": [r.tobytes() for r in total]})

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "sums": [np.sum([np.frombuffer(s) for s in pdf["sums"]], axis=0).tobytes()]})

    rows = labelled.mapInPandas(part, "i int, sums binary").groupBy("i").applyInPandas(summed, "i int, sums binary").collect()
    if not rows:
        return np.zeros(n)
    total = np.stack([np.frombuffer(r["sums"]) for r in sorted(rows)])
    count = max(1.0, total[-1, n - 1])
    return np.linalg.solve(total[:, :n] + ridge * count / n * np.eye(n), total[:, n])


def scored(docs: DataFrame, labels: DataFrame, cosines: int = COSINES, bandwidth: float = BANDWIDTH, ridge: float = RIDGE, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    docs needs doc_id and text, labels doc_id and quality (1 is good); further columns don't matter. Labels without id
    or quality, and those of held-out documents, are not used; repeated labels each count. All other labelled documents
    are: those with remainder 0 fit the regression, those with remainder 2 the calibration. A null or wordless text has
    zero statistics and a score like any other. Without usable labels every score is 0.5. Rows are scored one by one,
    whether or not ids repeat or are null. An empty table gives an empty result.
    """
    known = settled(measured(docs))
    row = known.agg(*[F.avg(s) for s in STATISTICS], *[F.stddev_pop(s) for s in STATISTICS]).first()
    stats = np.array([0.0 if v is None else v for v in row], float).reshape(2, -1)
    features = Cosines(*stats, cosines, bandwidth, seed)
    marked = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("label"))
    labelled = settled(known.join(marked, "doc_id").withColumn("fold", fold()).filter("fold <> 1"))
    weights = fit(labelled.filter("fold = 0"), features, ridge)

    def raw(pdf: pd.DataFrame) -> np.ndarray:
        return features(pdf[list(STATISTICS)].to_numpy(float)) @ weights

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = raw(pdf)
            yield pd.DataFrame({"bin": np.floor(np.clip(score, -0.5, 1.5) * BINS).astype("<i8"), "score": score, "label": pdf["label"]})

    bins = labelled.filter("fold = 2").mapInPandas(binned, "bin long, score double, label double").groupBy("bin").agg(F.count("*"), F.avg("score"), F.avg("label")).collect()
    x, y = isotonic(*np.array([[b[2], b[3], b[1]] for b in bins], float).reshape(-1, 3).T)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = np.clip(np.interp(raw(pdf), x, y), 0.0, 1.0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": p, "predicted": (p >= 0.5).astype(int)})

    return known.withColumn("held_out", fold() == 1).mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int")
