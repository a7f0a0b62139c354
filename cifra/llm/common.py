"""What several operators of this subpackage share: checkpoints, ordered document groups, packed exchanges."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import tempfile
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of everything except space and the ASCII controls 9 to 13; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch; with very long documents the default of 10,000 would not fit in a worker.
BATCH_ROWS = 1000
#: Bytes of a text's SHA-256 by which a copy is told.
DIGEST = 16
#: Rows of a few numbers that are sent to every task: some 10 MB.
SENT_ROWS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """df cut off from its lineage by a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sent_if_small(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """df settled, to be joined with a large table: sent to every task if it has at most so many rows, so that the large
    table stays where it is; dealt out like any other if it has more."""
    df = settled(df)
    return F.broadcast(df) if df.count() <= rows else df


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, spark.checkpoint.dir. Where none is set, one is made if all runs in one process
    (as in tests); on a cluster a folder of the driver's machine would lose what executors write, so that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder of the cluster's file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def short_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, and so the memory of a Python worker; and workers look for this package where
    the driver found it, unless it was installed or shipped to them otherwise."""
    root, seen = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in seen.get("PYTHONPATH", "").split(os.pathsep):
        seen["PYTHONPATH"] = os.pathsep.join(filter(None, (root, seen.get("PYTHONPATH"))))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text; null is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias("data")


def row_hash(names: list[str]) -> Column:
    """A hash that tells rows apart by the given columns, null by null, also where ids repeat or are null."""
    return F.xxhash64(*names, *[F.col(n).isNull() for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays (or bytes) as one compressed value; unpacked() reads them back as bytes."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpacked(value: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    (n,) = struct.unpack_from("<q", raw)
    sizes, at, out = struct.unpack_from(f"<{n}q", raw, 8), 8 * (n + 1), []
    for size in sizes:
        out.append(raw[at : at + size])
        at += size
    return out


def group_count(total_bytes: int) -> int:
    """Groups of documents: about 1 MB of text each for half a GB, growing with the root of the input up to 16 MB, so
    that neither the groups nor the messages between groups and buckets become many and small at once."""
    each = min(16e6, 1e6 * max(1.0, (total_bytes / 5e8) ** 0.5))
    return max(64, int(total_bytes / each) + 1)


def group_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds that are at most key: a binary search in the JVM. All bounds are one binary constant, eight
    bytes each in the order of their values, so that millions of them are still a small plan."""
    depth = max(1, len(bounds).bit_length())
    held = F.lit(b"".join((b + 2**63).to_bytes(8, "big") for b in bounds).ljust(8 << depth, b"\xff"))
    sortable = F.unhex(F.lpad(F.hex(key.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    steps = F.lit([2**i for i in reversed(range(depth))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.substring(held, 8 * (at + step - 1) + 1, F.lit(8)) <= sortable, step).otherwise(F.lit(0)))


class Grouped:
    """documents dealt into groups of consecutive doc_ids, with their exact copies known.

    frame: g, doc_id, data. Every group holds a range of doc_ids, and a smaller g holds smaller ids. The bounds are
    quantiles in which a document weighs one more than its length in mean lengths, so whatever the ids and lengths are,
    a group holds about twice the intended text at most, besides one document; only rows with one and the same doc_id
    stay together however many they are. So a copied or popular document never lands with all its copies in one task.
    copies: g, kind, key, payload rows that name each document whose whole text is also that of a smaller doc_id, by
    its doc_id (key) and the digest of its text (payload): another text under the same doc_id is no copy.
    Documents without doc_id are not in frame.
    """

    def __init__(self, docs: DataFrame, per_bucket: float):
        short_batches(docs.sparkSession)
        known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), text_bytes())
        total, n = known.agg(F.sum(F.length("data")), F.count("*")).first()
        self.total = total or 0
        self.groups = min(group_count(self.total), max(1, n))
        self.buckets = max(64, int(self.total * per_bucket / 1e6) + 1)
        cuts = F.split(F.lit(",".join(str(i / self.groups) for i in range(1, self.groups))), ",").cast("array<double>")
        weight = (1 + F.floor(F.length("data") * (n / max(1, self.total)))).cast("int")
        weighed = known.select("doc_id", F.explode(F.sequence(F.lit(1), weight)))
        bounds = weighed.agg(F.percentile_approx("doc_id", cuts, max(10_000, 2 * self.groups))).first()[0] if self.groups > 1 else []
        with_group = known.withColumn("g", group_of(F.col("doc_id"), sorted(set(bounds or []))))
        self.frame = with_group.select("g", "doc_id", "data")
        keys = with_group.select("g", "doc_id", F.sha2("data", 256).alias("content"))
        # Settled, so that the join deals out both sides itself and can split a content that very many documents have.
        firsts = settled(keys.groupBy("content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last"))
        self.copies = settled(keys.join(firsts, "content").filter("doc_id > first").select("g", F.lit("copy").alias("kind"), F.col("doc_id").alias("key"), F.unhex(F.substring("content", 1, 2 * DIGEST)).alias("payload")))


def copies_of(side: pd.DataFrame) -> set[tuple[int, bytes]]:
    """The doc_id and digest of each copy that a group's side rows name."""
    rows = side[side["kind"] == "copy"]
    return set(zip(rows["key"].tolist(), map(bytes, rows["payload"]), strict=True))


def are_copies(rows: list[tuple[int, bytes]], copies: set[tuple[int, bytes]]) -> np.ndarray:
    """Of each row (doc_id, text), whether it is one of copies; only texts whose doc_id is named are digested."""
    named = {c[0] for c in copies}
    return np.array([i in named and (i, hashlib.sha256(t).digest()[:DIGEST]) in copies for i, t in rows], bool)


MESSAGE = "g int, kind string, key long, payload binary"


def bucket_rows(g: int, kind: str, order: np.ndarray, buckets: np.ndarray, payload) -> Iterable[tuple]:
    """A message row for each bucket; order sorts the entries by bucket, payload(indexes) packs a bucket's entries."""
    if not len(order):
        return
    sorted_buckets = buckets[order]
    cuts = np.flatnonzero(np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
        yield g, kind, int(sorted_buckets[a]), payload(order[a:b])
