"""Command line: run, evaluate, errors."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cifra.operators import metrics, normalize, relational
from cifra.sources import io


def _answered(spark: SparkSession, args: argparse.Namespace, *required: str) -> DataFrame:
    df = relational.require_columns(io.read(spark, args.input), *required)
    return df.withColumn("answer", normalize.normalizer(args.parser_type, args.hybrid)(F.col("task_text")))


def _numbered(df: DataFrame) -> DataFrame:
    return df if "row_id" in df.columns else df.withColumn("row_id", F.monotonically_increasing_id())


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    out = args.output or io.answer_path(args.input)
    io.write(_answered(spark, args, "task_text"), out)
    metrics.run_report(io.read(spark, out)).show(truncate=False)


def evaluate(spark: SparkSession, args: argparse.Namespace) -> float | None:
    df = _answered(spark, args, "task_text", "ground_truth")
    if "noise_level" in df.columns:
        metrics.accuracy_by(df, "noise_level").show()
    metrics.evaluate_report(df).show()
    metrics.errors(_numbered(df), "row_id", 3).show(3, truncate=False)
    return metrics.accuracy(df).first()["pct"]


def errors(spark: SparkSession, args: argparse.Namespace) -> None:
    metrics.errors(_numbered(_answered(spark, args, "task_text", "ground_truth")), "row_id", args.n).show(args.n, truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cifra")
    commands = top.add_subparsers(dest="command", required=True)
    for name, f in (("run", run), ("evaluate", evaluate), ("errors", errors)):
        p = commands.add_parser(name)
        p.add_argument("input")
        p.add_argument("--hybrid", action="store_true")
        p.add_argument("--parser-type", choices=normalize.MODES, default="current")
        p.set_defaults(call=f)
        if name == "run":
            p.add_argument("-o", "--output")
        if name == "errors":
            p.add_argument("-n", type=int, default=15)
    return top


def main(argv: list[str] | None = None) -> object:
    args = parser().parse_args(argv)
    return args.call(SparkSession.builder.appName("cifra").getOrCreate(), args)


if __name__ == "__main__":
    main()
