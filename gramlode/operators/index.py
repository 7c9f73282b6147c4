"""The gram index: Parquet postings (gram, file_id), document counts of grams, and the file states.

Postings lie in folders by the grams' leading bits, so that a lookup opens few files, and are sorted by gram within each file, so that it
reads few row groups. Rows are dealt to tasks by folder and a hash of the row: a gram that all documents hold is spread like any
other, and the texts are gone through once (dealing by sampled ranges would extract the grams twice).

Each build writes a new generation folder and switches the CURRENT file last, so readers never see a half-written index
and a plan never overwrites what it reads.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramlode.functions.grams import extract
from gramlode.sources import corpus as co
from gramlode.sources import storage
from gramlode.sources.corpus import MAX_FILE_SIZE, status

FORMAT = 2
#: Text bytes for which a folder, or a part of one, is made; an upper bound of the postings.
FOLDER_BYTES, MOST_FOLDER_BITS = 64 << 20, 8
FILES = "file_id long, path string, size long, mtime_ns long, status string"


def postings_of(corpus: DataFrame | co.Directory) -> DataFrame:
    """(gram, file_id), distinct; only the key and the text are read."""
    return co.texts(corpus).select("file_id", "text").mapInArrow(extract, "gram int, file_id long")


def posting_lists(postings: DataFrame) -> DataFrame:
    """Array form, for export: a common gram's list grows with the corpus, so the index itself keeps rows."""
    return postings.groupBy("gram").agg(F.array_sort(F.collect_list("file_id")).alias("file_ids"))


def posting_gaps(postings: DataFrame, shift: int = 16) -> DataFrame:
    """Each id's distance to the one before in its list, the first one's to 0. A common gram's list is cut into stretches of 2 ** ``shift``
    ids, so that no task sorts all of it; each stretch needs the last id before it only."""
    cut = postings.select("gram", "file_id", F.shiftright("file_id", shift).alias("stretch"))
    ends = cut.groupBy("gram", "stretch").agg(F.max("file_id").alias("last"))
    ends = ends.withColumn("before", F.lag("last", 1, 0).over(Window.partitionBy("gram").orderBy("stretch"))).drop("last")
    own = F.lag("file_id").over(Window.partitionBy("gram", "stretch").orderBy("file_id"))
    return cut.withColumn("own", own).join(ends, ["gram", "stretch"]).select("gram", "file_id", (F.col("file_id") - F.coalesce("own", "before")).alias("gap"))


def from_gaps(gaps: DataFrame) -> DataFrame:
    """The inverse of posting_gaps(), given the lists' order in ``pos``."""
    run = Window.partitionBy("gram").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return gaps.select("gram", "pos", F.sum("gap").over(run).alias("file_id"))


def varint_bytes(n: Column) -> Column:
    """Length of a gap in 7-bit groups."""
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5)


def dense_ids(files: DataFrame) -> DataFrame:
    """0-based ids in path order without a single-partition window: rows are dealt by ranges of the path, sorted and written once, numbered within
    their range, and offset by the counts of the ranges before; the counts are one row for each range."""
    spark, path = files.sparkSession, storage.scratch(files.sparkSession)
    own = F.monotonically_increasing_id()  # range << 33 | number in it
    files.repartitionByRange("path").sortWithinPartitions("path").withColumn("own", own).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("part", F.shiftright("own", 33)).withColumn("own", F.col("own").bitwiseAND((1 << 33) - 1))
    offsets, total = [], 0
    for r in placed.groupBy("part").count().orderBy("part").collect():
        offsets.append((r.part, total))
        total += r["count"]
    offset = F.broadcast(spark.createDataFrame(offsets, "part long, offset long"))
    return placed.join(offset, "part").withColumn("dense_id", F.col("offset") + F.col("own")).drop("part", "own", "offset")


@dataclass
class Index:
    spark: SparkSession
    path: str
    generation: str
    meta: dict

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.generation}/{name}")

    @cached_property
    def postings(self) -> DataFrame:
        return self._read("postings")

    @cached_property
    def grams(self) -> DataFrame:
        """(gram, df)"""
        return self._read("grams")

    @cached_property
    def states(self) -> DataFrame:
        """Every file seen, with its status."""
        return self._read("files")

    @cached_property
    def files(self) -> DataFrame:
        return self.states.filter("status = 'indexed'")

    @property
    def file_count(self) -> int:
        return self.meta["file_count"]

    @property
    def gram_count(self) -> int:
        return self.meta["ngram_count"]

    def rows_of(self, grams: list[int]) -> DataFrame:
        """Postings of some grams: folders are pruned by their leading bits, row groups by the grams."""
        shift = self.meta["folder_shift"]
        return self.postings.filter(F.col("folder").isin(sorted({g >> shift for g in grams})) & F.col("gram").isin(grams)).select("gram", "file_id")

    def lookup(self, gram: int) -> DataFrame:
        return self.rows_of([gram]).select("file_id")

    def df_of(self, grams: list[int]) -> dict[int, int]:
        return {r.gram: r.df for r in self.grams.filter(F.col("gram").isin(grams)).collect()} if grams else {}

    def size(self) -> int:
        return storage.total_size(self.spark, f"{self.path}/{self.generation}")


def _write(spark: SparkSession, path: str, postings: DataFrame, files: DataFrame, extra: dict, began: float, size: int) -> Index:
    """``size``: bytes of all indexed texts."""
    generation = f"gen-{uuid.uuid4().hex}"
    out = f"{path}/{generation}"
    bits = min(MOST_FOLDER_BITS, (size // FOLDER_BYTES).bit_length())
    parts = max(1, size // (FOLDER_BYTES << bits))
    tasks = max(spark.sparkContext.defaultParallelism, parts << bits)
    spread = max(parts, -(-spark.sparkContext.defaultParallelism >> bits))
    folder = F.shiftright("gram", 24 - bits).alias("folder")
    dealt = postings.select("gram", "file_id", folder).repartition(tasks, "folder", F.pmod(F.xxhash64("gram", "file_id"), F.lit(spread)))
    dealt.sortWithinPartitions("folder", "gram", "file_id").write.partitionBy("folder").parquet(f"{out}/postings")
    extra = {"folder_shift": 24 - bits} | extra
    written = spark.read.parquet(f"{out}/postings")
    written.groupBy("gram").agg(F.count("*").alias("df")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{out}/grams")
    files.select("file_id", "path", "size", "mtime_ns", "status").write.parquet(f"{out}/files")
    counts = {r.status: r["count"] for r in spark.read.parquet(f"{out}/files").groupBy("status").count().collect()}
    grams, rows = spark.read.parquet(f"{out}/grams").agg(F.count("*"), F.sum("df")).first()
    meta = {"version": FORMAT, "file_count": counts.get("indexed", 0), "ngram_count": grams, "total_ngrams": rows or 0, "skipped_binary": counts.get("skipped_binary", 0), "skipped_large": counts.get("skipped_large", 0), "skipped_errors": counts.get("error", 0), "built_at_unix": int(time.time()), "build_duration_ms": int((time.time() - began) * 1000)} | extra
    storage.write_text(spark, f"{out}/meta.json", json.dumps(meta))
    before = storage.read_text(spark, f"{path}/CURRENT") if storage.exists(spark, f"{path}/CURRENT") else None
    storage.write_text(spark, f"{path}/CURRENT", generation)
    if before:
        storage.delete(spark, f"{path}/{before}")
    return Index(spark, path, generation, meta)


def with_status(corpus: DataFrame, max_size: int) -> DataFrame:
    return corpus.withColumn("status", F.when(F.col("text").isNull(), "error").otherwise(status(max_size)))


def build(corpus: DataFrame | co.Directory, path: str, max_size: int = MAX_FILE_SIZE, extra: dict | None = None) -> Index:
    began = time.time()
    marked = with_status(co.texts(corpus), max_size)
    size = co.states(corpus).filter(F.col("size") <= max_size).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return _write(marked.sparkSession, path, postings_of(marked.filter("status = 'indexed'")), marked, {"max_file_size": max_size} | (extra or {}), began, size)


def open_index(spark: SparkSession, path: str) -> Index:
    if not storage.exists(spark, f"{path}/CURRENT"):
        raise FileNotFoundError(f"no index in {path}")
    generation = storage.read_text(spark, f"{path}/CURRENT").strip()
    meta = json.loads(storage.read_text(spark, f"{path}/{generation}/meta.json"))
    if meta.get("version") != FORMAT:
        raise ValueError(f"unsupported index version {meta.get('version')}")
    return Index(spark, path, generation, meta)


def clean(spark: SparkSession, path: str) -> bool:
    """Deletes an index folder; only one that carries our marker."""
    if not storage.exists(spark, f"{path}/CURRENT"):
        return False
    return storage.delete(spark, path)


def update(index: Index, corpus: DataFrame | co.Directory, changes: DataFrame) -> Index:
    """Incremental: postings of untouched files stay, changed and added files are read again, deleted ones go.
    ``changes`` has (path, change); only the touched files' texts are read."""
    began = time.time()
    spark = index.spark
    max_size = index.meta["max_file_size"]
    dirty = index.states.join(changes.filter("change in ('changed', 'deleted')").select("path"), "path", "left_semi").select("file_id")
    fresh = with_status(co.texts(corpus, co.states(corpus).join(changes.filter("change in ('changed', 'added')").select("path"), "path", "left_semi")), max_size)
    postings = index.postings.join(dirty, "file_id", "left_anti").select("gram", "file_id").unionByName(postings_of(fresh.filter("status = 'indexed'")))
    files = index.states.join(dirty, "file_id", "left_anti").select("file_id", "path", "size", "mtime_ns", "status").unionByName(fresh.select("file_id", "path", "size", "mtime_ns", "status"))
    extra = {k: v for k, v in index.meta.items() if k in ("max_file_size", "root", "git_head")}
    size = files.filter("status = 'indexed'").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return _write(spark, index.path, postings, files, extra, began, size)
