"""Corpora: DataFrames (file_id BIGINT, path STRING, size BIGINT, mtime_ns BIGINT, text STRING, bad ARRAY<INT>).

``bad`` holds the 0-based lines that are not valid UTF-8: they count in the numbering but never match; null if there are none.
A table corpus is any DataFrame with a key and a text column. A directory corpus is a Directory: it lists files on the driver (names and sizes
only), drops ignored ones, and reads the contents of files that are asked for in the executors; a cluster needs the folder mounted on every machine.
states() and texts() take either kind.
"""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE_SIZE = 10 * 1024 * 1024
BINARY_PREFIX = 8192
INDEX_FOLDER, IGNORE_FILE = ".gramlode", ".gramlodeignore"
#: Folders skipped at any depth, and those skipped at the root only (fixed values).
IGNORED_ANYWHERE = ("node_modules", "venv", ".venv", "__pycache__", ".tox", ".mypy_cache", ".eggs", "*.egg-info", INDEX_FOLDER)
IGNORED_AT_ROOT = ("target", "dist", "build")
SCHEMA = "file_id long, path string, size long, mtime_ns long, text string, bad array<int>"


def table_corpus(df: DataFrame, key: Column, path: Column, text: Column, mtime_ns: Column | None = None) -> DataFrame:
    """Tables have no file times: pass a version column, or a content hash stands in."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    stamp = mtime_ns if mtime_ns is not None else F.xxhash64(text)
    return df.select(key.cast("long").alias("file_id"), path.alias("path"), F.octet_length(text).cast("long").alias("size"), stamp.cast("long").alias("mtime_ns"), text.alias("text"), F.lit(None).cast("array<int>").alias("bad"))


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table_corpus(d, d.doc_id, F.concat(d.source, F.lit("/"), d.lang, F.lit("/"), F.lpad(d.doc_id.cast("string"), 8, "0"), F.lit(".txt")), d.text)


def status(max_size: int = MAX_FILE_SIZE) -> Column:
    """Oversize is told before binary; a size equal to the limit is kept."""
    nul = F.position(F.lit(b"\0"), F.substring(F.encode("text", "UTF-8"), 1, BINARY_PREFIX)) > 0
    return F.when(F.col("size") > max_size, "skipped_large").when(F.contains("text", F.lit("\0")) & nul, "skipped_binary").otherwise("indexed")


# ---- directories


class IgnoreRules:
    """Patterns of ignore files, each relative to the folder that holds it; the last that fits decides. Paths are absolute."""

    def __init__(self):
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []

    def read(self, path: str, base: str) -> None:
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                rows = f.read().split("\n")
        except OSError:
            return
        self.add(rows, base)

    def add(self, rows: list[str], base: str) -> None:
        for row in rows:
            row = row.rstrip()
            if not row or row.startswith("#"):
                continue
            keep = row.startswith("!")
            row = row[keep:]
            only_folders = row.endswith("/")
            row = row.strip("/") if row.count("/") - only_folders == 0 else "/" + row.strip("/")
            self.rules.append((base, re.compile(self._translated(row)), keep, only_folders))

    @staticmethod
    def _translated(glob: str) -> str:
        anchored, glob = glob.startswith("/"), glob.lstrip("/")
        out = ""
        for part in re.split(r"(\*\*/|/\*\*|\*|\?|\[[^\]]*\])", glob):
            out += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part[:1] == "[" and part[-1:] == "]" else re.escape(part))
        return f"(?:{'' if anchored else '(?:.*/)?'}{out})\\Z"

    def ignored(self, path: str, is_folder: bool) -> bool:
        for base, pattern, keep, only_folders in reversed(self.rules):
            base = base.rstrip("/") + "/"
            if (not only_folders or is_folder) and path.startswith(base) and pattern.match(path[len(base) :]):
                return not keep
        return False


def _global_excludes() -> str:
    """The user's own ignore file: what git's configuration names, or its usual place."""
    try:
        told = subprocess.run(["git", "config", "--path", "--get", "core.excludesFile"], capture_output=True, text=True, timeout=10).stdout.strip()
    except (OSError, subprocess.TimeoutExpired):
        told = ""
    return told or os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore")


def _above(root: str) -> list[str]:
    """Folders from the file system's root down to the parent of ``root``."""
    out, at = [], os.path.dirname(os.path.abspath(root))
    while at not in out:
        out.append(at)
        at = os.path.dirname(at)
    return out[::-1]


def walk(root: str) -> Iterator[tuple[str, int, int]]:
    """(relative path, size, mtime in ns) of regular files, sorted by path; hidden and ignored ones are left out.

    Inside a git repository the user's ignore file, the repository's own list and the .gitignore files from its top down count; our own
    ignore files count from any folder above."""
    found: list[tuple[str, int, int]] = []
    rules = IgnoreRules()
    root = os.path.abspath(root)
    top = next((p for p in [root, *_above(root)[::-1]] if os.path.exists(os.path.join(p, ".git"))), None)
    in_git = top is not None
    if in_git:
        rules.read(_global_excludes(), top)
        rules.read(os.path.join(top, ".git/info/exclude"), top)
    for folder in _above(root):
        for name in ([".gitignore"] if in_git and (folder + os.sep).startswith(top + os.sep) else []) + [IGNORE_FILE]:
            rules.read(os.path.join(folder, name), folder)

    def visit(folder: str, rel: str) -> None:
        before = len(rules.rules)
        for name in ([".gitignore"] if in_git else []) + [IGNORE_FILE]:
            rules.read(os.path.join(folder, name), folder)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            entries = []
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            if e.name.startswith(".") or e.is_symlink():
                continue
            if e.is_dir():
                if not any(fnmatch.fnmatchcase(e.name, p) for p in IGNORED_ANYWHERE + (IGNORED_AT_ROOT if not rel else ())) and not rules.ignored(e.path, True):
                    visit(e.path, path)
            elif e.is_file() and not rules.ignored(e.path, False):
                s = e.stat()
                found.append((path, s.st_size, s.st_mtime_ns))
        del rules.rules[before:]

    visit(root, "")
    return iter(sorted(found, key=lambda x: x[0].encode(errors="surrogateescape")))


def decoded(content: bytes) -> tuple[str, list[int] | None]:
    try:
        return content.decode(), None
    except UnicodeDecodeError:
        bad = []
        for i, line in enumerate(content.split(b"\n")):
            try:
                line.decode()
            except UnicodeDecodeError:
                bad.append(i)
        return content.decode(errors="replace"), bad


def _read(root: str, max_size: int | None):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                text, bad = "", None
                if max_size is None or row["size"] <= max_size:
                    try:
                        with open(os.path.join(root, row["path"]), "rb") as f:
                            text, bad = decoded(f.read())
                    except OSError:
                        text = None  # gone or unreadable: status error
                yield pa.RecordBatch.from_pylist([row | {"text": text, "bad": bad}], schema=pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("text", pa.string()), ("bad", pa.list_(pa.int32()))]))

    return run


def listing(spark: SparkSession, root: str) -> DataFrame:
    """File states; the key is a hash of the path, so it stays when other files come and go."""
    rows = list(walk(root))
    df = spark.createDataFrame(rows, "path string, size long, mtime_ns long")
    return df.select(F.xxhash64("path").alias("file_id"), "path", "size", "mtime_ns")


class Directory:
    """A directory corpus, as it is when first listed. Contents over ``max_size`` bytes are not read; None reads all."""

    def __init__(self, spark: SparkSession, root: str, max_size: int | None = MAX_FILE_SIZE):
        self.spark, self.root, self.max_size, self._listed = spark, root, max_size, None

    def states(self) -> DataFrame:
        if self._listed is None:
            self._listed = listing(self.spark, self.root)
        return self._listed

    def texts(self, files: DataFrame | None = None) -> DataFrame:
        """The files, or those of ``files`` (file_id): no other is opened."""
        listed = self.states() if files is None else self.states().join(files.select("file_id"), "file_id", "left_semi")
        return listed.select("file_id", "path", "size", "mtime_ns").repartition(max(8, self.spark.sparkContext.defaultParallelism)).mapInArrow(_read(self.root, self.max_size), SCHEMA)


def directory_corpus(spark: SparkSession, root: str, max_size: int | None = MAX_FILE_SIZE) -> Directory:
    return Directory(spark, root, max_size)


def states(corpus: DataFrame | Directory) -> DataFrame:
    """file_id, path, size and mtime_ns; a directory's contents are not read."""
    return corpus.states() if isinstance(corpus, Directory) else corpus


def texts(corpus: DataFrame | Directory, files: DataFrame | None = None) -> DataFrame:
    """All columns of all files, or of those of ``files`` (file_id)."""
    if isinstance(corpus, Directory):
        return corpus.texts(files)
    return corpus if files is None else corpus.join(files.select("file_id"), "file_id", "left_semi")


def project_root(start: str) -> str:
    """The nearest folder upwards that holds .git, else the start."""
    at = os.path.abspath(start)
    while not os.path.isdir(os.path.join(at, ".git")):
        if os.path.dirname(at) == at:
            return os.path.abspath(start)
        at = os.path.dirname(at)
    return at


def find_index(start: str) -> str | None:
    at = os.path.abspath(start)
    while not os.path.isdir(os.path.join(at, INDEX_FOLDER)):
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)
    return os.path.join(at, INDEX_FOLDER)


def git_head(root: str) -> str | None:
    try:
        done = subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None
