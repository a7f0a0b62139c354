"""The normalizers over streams: they are narrow expressions, so a stream needs no state for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cifra.functions import text
from cifra.operators.normalize import with_answer


def normalized_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "current") -> StreamingQuery:
    """Appends a stream with task_text, and its answers, to Parquet; every record arrives once."""
    return with_answer(stream, mode).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def numbers_by_window(stream: DataFrame, ts: str = "ts", column: str = "answer", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """How many texts and numbers a window of event time has; later records than `late` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size)).agg(F.count("*").alias("n"), F.sum(text.count_numbers(F.col(column))).alias("numbers"))
