"""Checks of notebooks (JSON, format 4) held in a column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "nbformat int, cells array<struct<cell_type:string, source:string, outputs:array<struct<output_type:string, ename:string>>>>"
#: Assignments of data in code.
INLINE = r"(task_text|ground_truth)\s*=\s*['\"]"


def source_of(cell: Column) -> Column:
    """A cell's text, which the format holds as one string or as a list of lines."""
    lines = F.from_json(cell["source"], "array<string>")
    return F.coalesce(F.when(F.startswith(cell["source"], F.lit("[")), F.array_join(lines, "")), cell["source"], F.lit(""))


def checked(df: DataFrame, column: str, row_id: str, sections: Iterable[str] = (), forbidden: Iterable[str] = (), required: Iterable[str] = (), wished: Iterable[str] = ()) -> DataFrame:
    """row_id, errors, warnings (how many of each) and passed, which is no errors.

    Errors: what is no JSON or has no cells (nothing else counts then); each error among outputs; each forbidden text in
    code, and each required one that no code has. Warnings: another format than 4; each code cell that is blank, or that
    follows another one; headings that lack one of the sections (in lower case); each wished text that no code has; data
    assigned in code.
    """
    nb = F.from_json(F.col(column), SCHEMA)
    book = df.select(F.col(row_id), nb.alias("nb")).select(row_id, F.col("nb.nbformat").alias("form"), F.coalesce(F.col("nb.cells"), F.array().cast("array<struct<cell_type:string,source:string,outputs:array<struct<output_type:string,ename:string>>>>")).alias("cells"))
    is_code = lambda c: F.coalesce(c["cell_type"] == "code", F.lit(False))
    book = book.withColumn("code", F.filter("cells", is_code)).withColumn("sources", F.transform("code", source_of)).withColumn("text", F.array_join("sources", "\n"))
    headings = F.filter(F.split(F.lower(F.array_join(F.transform(F.filter("cells", lambda c: c["cell_type"] == "markdown"), source_of), "\n")), "\n"), lambda line: F.startswith(line, F.lit("#")))
    book = book.withColumn("headings", F.array_join(headings, "\n"))
    has = lambda c, text: F.contains(F.col(c), F.lit(text))
    count = lambda conditions: sum((c.cast("int") for c in conditions), F.lit(0))
    failed = F.aggregate(F.transform("code", lambda c: F.size(F.filter(F.coalesce(c["outputs"], F.array().cast("array<struct<output_type:string,ename:string>>")), lambda o: o["output_type"] == "error"))), F.lit(0), lambda a, n: a + n)
    in_a_row = F.size(F.filter(F.transform("cells", lambda c, i: is_code(c) & (i > 0) & is_code(F.get(F.col("cells"), i - 1))), lambda x: F.coalesce(x, F.lit(False))))
    errors = failed + count(has("text", t) for t in forbidden) + count(~has("text", t) for t in required)
    warnings = (~F.col("form").eqNullSafe(F.lit(4))).cast("int") + F.size(F.filter("sources", lambda s: F.trim(F.regexp_replace(s, r"\s", "")) == "")) + in_a_row + F.rlike(F.col("text"), F.lit(INLINE)).cast("int")
    warnings = warnings + count(~has("text", t) for t in wished)
    sections = tuple(sections)
    if sections:
        warnings = warnings + (count(~has("headings", s) for s in sections) > 0).cast("int")
    none = F.size("cells") == 0
    out = book.select(row_id, F.when(none, 1).otherwise(errors).cast("long").alias("errors"), F.when(none, 0).otherwise(warnings).cast("long").alias("warnings"))
    return out.withColumn("passed", F.col("errors") == 0)
