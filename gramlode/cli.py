"""Command line: index, search, status and clean for a directory of files. python -m gramlode.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from gramlode.functions.text import format_size, parse_size
from gramlode.operators import freshness, render
from gramlode.operators import index as ix
from gramlode.operators import search as se
from gramlode.plans import gram_plan as gp
from gramlode.plans.regex import PatternError, parse
from gramlode.sources import corpus as co


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gramlode")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index")
    p.add_argument("path", nargs="?")
    p.add_argument("--force", action="store_true")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--max-file-size", default="10M")
    p.add_argument("--json", action="store_true")
    p = sub.add_parser("search")
    p.add_argument("pattern")
    p.add_argument("-i", "--ignore-case", action="store_true")
    p.add_argument("-f", "--file")
    p.add_argument("-l", "--files-only", action="store_true")
    p.add_argument("--no-index", action="store_true")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("-C", "--context", type=int, default=0)
    p.add_argument("-A", "--after-context", type=int)
    p.add_argument("-B", "--before-context", type=int)
    p.add_argument("--json", action="store_true")
    p.add_argument("-m", "--max-count", type=int)
    p = sub.add_parser("status")
    p.add_argument("--json", action="store_true")
    sub.add_parser("clean")
    return top


def session() -> SparkSession:
    spark = SparkSession.builder.master(os.environ.get("SPARK_MASTER", "local[*]")).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _extra(root: str) -> dict:
    head = co.git_head(root)
    return {"root": root} | ({"git_head": head} if head else {})


def _build(spark: SparkSession, root: str, size: int) -> ix.Index:
    return ix.build(co.directory_corpus(spark, root, size), os.path.join(root, co.INDEX_FOLDER), size, _extra(root))


def _stats(index: ix.Index) -> str:
    m = index.meta
    return f"Index statistics:\n  files:    {m['file_count']}\n  n-grams:  {m['ngram_count']}\n  built in: {m['build_duration_ms']}ms\n  size:     {format_size(index.size())}"


def do_index(args) -> int:
    root, size = os.path.abspath(args.path or "."), parse_size(args.max_file_size)
    spark, folder, began = session(), os.path.join(os.path.abspath(args.path or "."), co.INDEX_FOLDER), time.time()
    if args.stats:
        print(_stats(ix.open_index(spark, folder)))
        return 0
    if args.force or not os.path.exists(os.path.join(folder, "CURRENT")):
        index, mode = _build(spark, root, size), "full rebuild"
    else:
        index, mode = freshness.refresh(ix.open_index(spark, folder), co.directory_corpus(spark, root, size), size)
    ms = int((time.time() - began) * 1000)
    if args.json:
        print(json.dumps({"type": "index", "file_count": index.file_count, "ngram_count": index.gram_count, "duration_ms": ms, "index_size": format_size(index.size()), "mode": mode, "max_file_size": format_size(size)}, separators=(",", ":")))
    else:
        print(f"Indexed {index.file_count} files, {index.gram_count} unique n-grams in {ms}ms ({format_size(index.size())}) [{mode}] (max file size: {format_size(size)})")
    if index.meta["skipped_errors"]:
        print(f"{index.meta['skipped_errors']} files skipped due to read errors", file=sys.stderr)
    return 0


def context_lines(context: int, before: int | None, after: int | None) -> tuple[int, int]:
    """Lines before and after: either side's own flag goes before the common one."""
    return (context if before is None else before), (context if after is None else after)


def do_search(args) -> int:
    parse(args.pattern)
    if args.explain:
        print(gp.explain(gp.plan_of(args.pattern, args.ignore_case)))
        return 0
    spark, began = session(), time.time()
    before, after = context_lines(args.context, args.before_context, args.after_context)
    flags = {"ignore_case": args.ignore_case, "path_filter": args.file, "files_only": args.files_only, "before": before, "after": after, "limit": args.max_count}
    if args.no_index:
        root = co.project_root(".")
        corpus = co.directory_corpus(spark, root, None)
        matches, mode = se.scan(corpus, args.pattern, **flags), "no-index"
        total = searched = se.filtered(co.listing(spark, root), args.file).count()
    else:
        folder = co.find_index(".")
        root = os.path.dirname(folder) if folder else co.project_root(".")
        if folder is None:
            index = _build(spark, root, co.MAX_FILE_SIZE)
        else:
            index = ix.open_index(spark, folder)
            index, how = freshness.refresh(index, co.directory_corpus(spark, root, index.meta["max_file_size"]))
            if how != "fresh":
                print(f"index updated: {how}", file=sys.stderr)
        corpus = co.directory_corpus(spark, root, index.meta["max_file_size"])
        choice = se.chosen(index, args.pattern, ignore_case=args.ignore_case, path_filter=args.file)
        matches = se.search(index, corpus, args.pattern, choice=choice, **flags)
        mode, searched, total = choice.mode, choice.candidates, index.file_count
    matches = matches.cache()
    summary = se.summary(matches, searched, total, mode)
    found = summary.first()
    ms = int((time.time() - began) * 1000)
    if args.json:
        for r in render.json_lines(matches).orderBy("path", "line_number").toLocalIterator():
            print(r.json)
        print(render.summary_json(summary, ms).first().json)
    else:
        colour = sys.stdout.isatty() and not args.no_color
        shown = render.text(matches, files_only=args.files_only, pattern=args.pattern if colour else None, ignore_case=args.ignore_case)
        first = True
        for r in shown.orderBy("path", "line_number").toLocalIterator():
            if (before or after) and not args.files_only and not first:
                print("--")
            print(r.text)
            first = False
        print(f"{found.match_count} matches in {found.file_count} files ({found.files_searched} of {found.total_files} searched, {ms}ms) [{found['mode']}]", file=sys.stderr)
    return 0 if found.match_count else 1


def do_status(args) -> int:
    folder = co.find_index(".")
    if folder is None:
        print(json.dumps({"type": "status", "indexed_files": 0, "ngram_count": 0, "freshness": "none", "changes": 0}, separators=(",", ":")) if args.json else "No index found.")
        return 0
    spark = session()
    index = ix.open_index(spark, folder)
    root = os.path.dirname(folder)
    counts = {r.change: r["count"] for r in freshness.diff(index.states, co.listing(spark, root)).groupBy("change").count().collect()}
    if args.json:
        print(json.dumps({"type": "status", "indexed_files": index.file_count, "ngram_count": index.gram_count, "freshness": "stale" if counts else "fresh", "changes": sum(counts.values())}, separators=(",", ":")))
    else:
        told = f"STALE: {counts.get('changed', 0)} changed, {counts.get('added', 0)} new, {counts.get('deleted', 0)} deleted" if counts else "index is fresh"
        print(f"Index found at: {folder}\nProject root:   {root}\n{_stats(index)}\n  freshness: {told}")
    return 0


def do_clean(args) -> int:
    folder = co.find_index(".")
    print("Index removed." if folder and ix.clean(session(), folder) else "No index found.")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    try:
        return {"index": do_index, "search": do_search, "status": do_status, "clean": do_clean}[args.command](args)
    except (PatternError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
