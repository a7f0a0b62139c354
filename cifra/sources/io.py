"""Tables in and out: Parquet as the distributed format, Feather (Arrow IPC) files for exchange, JSON lists."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FeatherPart(InputPartition):
    def __init__(self, path: str, batch: int):
        super().__init__(batch)
        self.path = path


class FeatherReader(DataSourceReader):
    """A task for each record batch, so that a large file is read in parallel. Paths must be readable on every machine."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import pyarrow as pa

        with pa.memory_map(self.path) as f:
            return [FeatherPart(self.path, i) for i in range(pa.ipc.open_file(f).num_record_batches)]

    def read(self, partition: FeatherPart) -> Iterator:
        import pyarrow as pa

        with pa.memory_map(partition.path) as f:
            yield pa.ipc.open_file(f).get_batch(partition.value)


class FeatherSource(DataSource):
    """spark.read.format("feather").load(path), after register(spark)."""

    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        with pa.memory_map(self.options["path"]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema) -> DataSourceReader:
        return FeatherReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeatherSource)


def read(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".f", ".feather", ".arrow")):
        register(spark)
        return spark.read.format("feather").load(path)
    return spark.read.parquet(path)


def _as_streams(batches: Iterator) -> Iterator:
    """Each record batch as the bytes of an Arrow stream of its own."""
    import pyarrow as pa

    for b in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, b.schema) as w:
            w.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["stream"])


def write(df: DataFrame, path: str) -> None:
    """Parquet, or for a .f path one Feather file for exchange; its partitions come to the driver one at a time."""
    if not path.endswith((".f", ".feather", ".arrow")):
        df.write.mode("overwrite").parquet(path)
        return
    import pyarrow as pa

    first = df.limit(0).toArrow().schema
    with pa.ipc.new_file(path, first) as w:
        for row in df.mapInArrow(_as_streams, "stream binary").toLocalIterator():
            for b in pa.ipc.open_stream(bytes(row[0])):
                w.write_table(pa.Table.from_batches([b]).cast(first))


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as the cluster has slots, if it has fewer: a table of a few large row groups is read by
    as many tasks, and what is computed from it would keep the other slots idle. A larger table isn't shuffled."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


#: Rows of a partition that evened() makes, and how many partitions it makes at most.
EVEN_ROWS, MOST_PARTS = 300_000, 10_000


def evened(df: DataFrame) -> DataFrame:
    """spread(), also of a file that is cut into enough parts but read by few of them: a row group goes whole to the part
    that holds its middle, so one group of all rows leaves every other part empty. Where a part has over twice the mean,
    or more rows than a task should compute, all rows are dealt out, so that tasks don't grow with the table. The count
    reads no columns of a table of files."""
    out = spread(df)
    if out is not df or not df.inputFiles():
        return out
    parts, rows = df.rdd.getNumPartitions(), [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    # As many as fill all slots each time.
    slots, most = df.sparkSession.sparkContext.defaultParallelism, max(rows, default=0)
    wanted = max(parts, min(slots * -(-sum(rows) // (EVEN_ROWS * slots)), MOST_PARTS))
    if most * parts <= 2 * sum(rows) and (most <= EVEN_ROWS or wanted == parts):
        return df
    # By a row's place in its part, which a repeated task finds again: dealing rows out in turn would sort each part first.
    return df.repartition(wanted, F.monotonically_increasing_id())


def write_json_array(df: DataFrame, column: str, path: str) -> None:
    """The distinct values of a column as one file with a JSON array, for exchange; partitions come to the driver one at
    a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(df.filter(F.col(column).isNotNull()).select(F.to_json(F.array(column)).alias("one")).distinct().toLocalIterator()):
            f.write(",\n" * (i > 0) + row["one"][1:-1])
        f.write("]\n")


def write_json_list(df: DataFrame, column: str, path: str) -> None:
    """The distinct values of a column, a JSON object a line."""
    df.select(column).distinct().write.mode("overwrite").json(path)


def answer_path(path: str) -> str:
    """Where results of an input go unless told otherwise: beside it, in its own format, as only a Feather input is
    known to fit one file."""
    stem, dot, end = path.rstrip("/").rpartition(".")
    feather = path.endswith((".f", ".feather", ".arrow"))
    return f"{stem if dot and (feather or end == 'parquet') else path.rstrip('/')}_answer{'.f' if feather else '.parquet'}"
