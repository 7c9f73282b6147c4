"""Regex search over a corpus, pruned by the gram index where that pays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.functions.text import lines
from gramlode.operators.index import Index
from gramlode.plans import gram_plan as gp
from gramlode.plans.regex import to_java
from gramlode.sources import corpus as co

#: Above this share of the files, a scan of all is cheaper than the index.
SCAN_SHARE = 0.10
#: Candidates whose keys become a filter of a table's scan; with more, a semi-join tells them.
PUSHED = 1000


def candidates(index: Index, plan: gp.Plan) -> DataFrame:
    """file_id of the files that hold the plan's grams: one aggregation over the postings of these grams only."""
    grams = gp.grams_of(plan)
    if isinstance(plan, gp.FullScan):
        return index.files.select("file_id")
    return index.rows_of(grams).groupBy("file_id").agg(gp.presence(plan).alias("have")).filter(gp.holds(plan, F.col("have"))).select("file_id")


def filtered(files: DataFrame, path_filter: str | None) -> DataFrame:
    """The path pattern is never case-insensitive."""
    return files if path_filter is None else files.filter(F.rlike("path", F.lit(to_java(path_filter))))


def scan(corpus: DataFrame | co.Directory, pattern: str, *, ignore_case: bool = False, path_filter: str | None = None, files_only: bool = False, before: int = 0, after: int = 0, limit: int | None = None, ordered: bool = True) -> DataFrame:
    """Matches (path, line_number, line_text, context_before, context_after) without an index, by path and line.

    Each line is matched alone. Lines are exploded before matching so that the pattern runs in generated code; the line array travels
    along only if context is asked for."""
    java = F.lit(to_java(pattern, ignore_case))
    if isinstance(corpus, co.Directory):  # other files are not opened
        corpus = corpus.texts(filtered(corpus.states(), path_filter) if path_filter else None)
    corpus = filtered(corpus, path_filter)
    no_lines = F.lit(None).cast("array<string>")
    empty = F.array().cast("array<string>")
    context = (before > 0 or after > 0) and not files_only
    split = corpus.select("path", "bad", lines(F.col("text")).alias("lines"))
    rows = split.select("path", "bad", ("lines" if context else no_lines.alias("lines")), F.posexplode("lines").alias("i", "line"))
    good = F.rlike("line", java) & (F.col("bad").isNull() | ~F.array_contains("bad", F.col("i")))
    rows = rows.filter(good)
    if files_only:
        out = rows.select("path").distinct().select("path", F.lit(0).alias("line_number"), F.lit("").alias("line_text"), empty.alias("context_before"), empty.alias("context_after"))
    else:
        i = F.col("i")
        out = rows.select(
            "path", (i + 1).alias("line_number"), F.col("line").alias("line_text"),
            (F.slice("lines", F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before))) if context and before else empty).alias("context_before"),
            (F.slice("lines", i + 2, F.lit(after)) if context and after else empty).alias("context_after"),
        )
    if ordered or limit is not None:
        out = out.orderBy("path", "line_number")
    return out if limit is None else out.limit(limit)


@dataclass
class Choice:
    """How a search goes: the mode's name, the number of candidates after the path filter, and these, or None where all files are scanned."""

    mode: str
    candidates: int
    files: DataFrame | None


def chosen(index: Index, pattern: str, *, ignore_case: bool = False, path_filter: str | None = None, scan_share: float = SCAN_SHARE) -> Choice:
    """The one place that decides, by the share of candidates after the path filter."""
    plan = gp.plan_of(pattern, ignore_case)
    if isinstance(plan, gp.FullScan):
        return Choice("full-scan", filtered(index.files, path_filter).count(), None)
    files = filtered(index.files.join(candidates(index, plan), "file_id", "left_semi"), path_filter)
    n = files.count()
    return Choice("rg-fullscan", n, None) if n / max(index.file_count, 1) > scan_share else Choice("indexed", n, files)


def search(index: Index, corpus: DataFrame | co.Directory, pattern: str, *, ignore_case: bool = False, scan_share: float = SCAN_SHARE, choice: Choice | None = None, **flags) -> DataFrame:
    """Like scan(), over the indexed files; of few candidates by the index, only these are read."""
    path_filter = flags.get("path_filter")
    choice = choice or chosen(index, pattern, ignore_case=ignore_case, path_filter=path_filter, scan_share=scan_share)
    files = choice.files
    if files is None and (isinstance(corpus, co.Directory) or index.file_count < _known(index)):
        files = filtered(index.files, path_filter)
    if isinstance(corpus, DataFrame) and choice.files is not None and choice.candidates <= PUSHED:
        corpus, files = corpus.filter(F.col("file_id").isin([r.file_id for r in files.select("file_id").collect()])), None
    return scan(co.texts(corpus, files), pattern, ignore_case=ignore_case, **flags)


def _known(index: Index) -> int:
    m = index.meta
    return m["file_count"] + m["skipped_binary"] + m["skipped_large"] + m["skipped_errors"]


def mode(index: Index, pattern: str, ignore_case: bool = False, path_filter: str | None = None) -> tuple[str, int]:
    """The mode's name and the number of candidates after the path filter, as search() takes them."""
    choice = chosen(index, pattern, ignore_case=ignore_case, path_filter=path_filter)
    return choice.mode, choice.candidates


def summary(matches: DataFrame, files_searched: int, total_files: int, mode_name: str) -> DataFrame:
    """One row: match_count, file_count, files_searched, total_files, mode."""
    return matches.agg(F.count("*").alias("match_count"), F.countDistinct("path").alias("file_count")).select("match_count", "file_count", F.lit(files_searched).cast("long").alias("files_searched"), F.lit(total_files).cast("long").alias("total_files"), F.lit(mode_name).alias("mode"))
