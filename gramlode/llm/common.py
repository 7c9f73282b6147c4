"""What the operators share: tables, scratch space in the shared folder, and text columns as flat byte arrays."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker looks at in one step, unless a single text is longer.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch between Spark and Python: with the default of 10,000, one batch is a task's whole input, held by both.
BATCH_ROWS = 500

_made: dict[str, list] = {}


def bounded(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches, and without the shuffle files of queries that have ended (they would stay until the driver
    happens to collect its garbage). Settings of the user that are stricter stay."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session may do without it and gets one below its warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/.work/{spark.sparkContext.applicationId}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """The rows written to the shared folder and read again: cuts the lineage, survives lost executors. Steps that are done with the files
    call drop_saved(); what a returned DataFrame reads stays until the driver ends."""
    spark = bounded(df.sparkSession)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made[path] = [spark]
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _sweep() -> None:
    for path, (spark,) in list(_made.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone before us
            return


def drop_saved(*frames: DataFrame) -> None:
    """Deletes files written by saved() that no later step reads."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, path)
            for known in [k for k in _made if path.endswith(k.rsplit("/", 1)[1])]:
                del _made[known]


def step_entries(total: int, least: int, most: int, block: int = 64) -> int:
    """Entries of a batch and of a bucket for this many in all: about the square root of ``block`` times all, so that the part of a batch that goes
    to a bucket keeps that size, within bounds that bound a task's memory."""
    return int(min(most, max(least, (block * total) ** 0.5)))


def hot_from(total: int, entries: int, least: int) -> int:
    """How often a key must be in a batch to be hot: other keys then fill half of a bucket at most, however many batches hold them; for sizes
    above the least of step_entries(), 32 would do whatever the total."""
    return max(least, entries * entries // (2 * max(1, total)))


def dealt(df: DataFrame, key: str, groups: int) -> DataFrame:
    """About as many partitions as groups, within the session's number and 16 times that: few groups share a task."""
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(few, min(groups, 16 * few)), key)


def runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: where each combination begins, and every row's number of it."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def text_chunks(batches, column: str = "text", budget: int = CHUNK_BYTES):
    """Of each Arrow batch, slices whose texts hold at most ``budget`` bytes (one row at least): the slice, the
    texts' UTF-8 bytes in one array, and where each begins and the last ends. A null is an empty text."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if col.null_count:
            col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
        wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
        _, offs, data = col.buffers()
        offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + budget, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def is_space() -> np.ndarray:
    """For each byte, whether it parts words: space and 9 to 13."""
    t = np.zeros(256, bool)
    t[[32, *range(9, 14)]] = True
    return t


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many each text has."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    word = ~is_space()[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True  # a text's first byte begins a word, whatever the text before ended with
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes, modulo 2**64, of any stretch of a byte array: one multiplication each, after one pass."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, seed: int = 11):
        self.byte = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64, 256, np.uint64, endpoint=False)
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            self.powers = np.full(n, self.BASE, np.uint64)
            self.powers[0] = 1
            np.cumprod(self.powers, out=self.powers)
            self.inverse = np.full(n, pow(self.BASE, -1, 2**64), np.uint64)
            self.inverse[0] = 1
            np.cumprod(self.inverse, out=self.inverse)

    def over(self, data: np.ndarray) -> "Rolling":
        self._grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.powers[: len(data)], out=self.sums[1:])
        return self

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
