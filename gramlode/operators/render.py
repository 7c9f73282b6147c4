"""Matches as text, coloured text and JSON lines; all as expressions, rendered in the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.functions.text import CYAN, GREEN, MAGENTA, RESET, highlighted
from gramlode.plans.regex import to_java


def json_lines(matches: DataFrame) -> DataFrame:
    row = F.struct(F.lit("match").alias("type"), "path", "line_number", "line_text", "context_before", "context_after")
    return matches.select("path", "line_number", F.to_json(row).alias("json"))


def summary_json(summary: DataFrame, duration_ms: int) -> DataFrame:
    row = F.struct(F.lit("summary").alias("type"), "match_count", "file_count", "files_searched", "total_files", F.lit(duration_ms).cast("long").alias("duration_ms"), "mode")
    return summary.select(F.to_json(row).alias("json"))


def text(matches: DataFrame, *, files_only: bool = False, pattern: str | None = None, ignore_case: bool = False) -> DataFrame:
    """(path, line_number, text): the match with its context lines; with ``pattern``, coloured for a terminal."""
    colour = pattern is not None
    paint = lambda c, code: F.concat(F.lit(code), c.cast("string"), F.lit(RESET)) if colour else c.cast("string")
    path = paint(F.col("path"), MAGENTA)

    def row(sep: str, number: Column, line: Column) -> Column:
        s = paint(F.lit(sep), CYAN)
        return F.concat(path, s, paint(number, GREEN), s, line)

    n = F.col("line_number")
    line = F.col("line_text") if not colour else highlighted(F.col("line_text"), to_java(pattern, ignore_case))
    before = F.transform("context_before", lambda x, i: row("-", n - F.size("context_before") + i, x))
    after = F.transform("context_after", lambda x, i: row("-", n + 1 + i, x))
    shown = path if files_only else F.array_join(F.concat(before, F.array(row(":", n, line)), after), "\n")
    return matches.select("path", "line_number", shown.alias("text"))
