"""Approximate nearest neighbours by multi-index hashing.

Unit vectors get binary codes: signs after rotations learned by iterative quantization. A code is split into substrings of 32 bits, and each
substring position has an index of its own. Two codes within radius r agree, by the pigeonhole principle, within r // m bits on one of the
m substrings at least (one bit less on all but the first r % m + 1): probing these values of each index retrieves every code within the
radius. An index has a directory for either half of its substring, of at most 65,536 cells each, and the same principle tells which cells can
hold a near value; only values in those cells are looked at, only rows of near values have their whole codes compared, and only rows within
the radius are ranked by cosine on the original vectors. How many rows are probed depends on the data: few in clusters, a third or so where
vectors lie evenly on the sphere (see the README).

The radius is learned: for a bounded sample of queries the true neighbours are found by brute force over all rows, and the radius is
the smallest that holds QUANTILE of them. One radius does not suit all: a query in a thin region may find fewer than k rows within it, or
rows so far off that nearer ones may lie outside. So each query's k-th row tells how far the codes of nearer vectors can be (the angle's share
of the bits, and as many deviations as the sample's neighbours show, SPREAD at least), and queries that need a wider radius are asked again with it;
with fewer than k rows, with growing ones up to the whole code, where every row is found. Fewer than k rows come out only if there are not more. The index covers all rows, in blocks by hash of the id. A
block's rows come first, then all queries stream past its index: rows are sent once, queries once to each block, and a task holds one block. Equal
vectors of a block are searched once; of them, the smallest k + 1 ids are kept, which no
answer can exceed.

Vectors that are null, zero, hold a null or a non-finite component, or have not the commonest length, take no part; nor do rows without
an id. Repeated rows of an id count once (of different vectors, the least). Ties go to the smaller id. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlode.llm.common import bounded, saved

#: Bits of a code (a multiple of 64), vectors that train and queries that calibrate (in the mean), and the share of their neighbours within the radius.
BITS, TRAIN_ROWS, CALIBRATE, QUANTILE = 128, 8192, 128, 0.95
#: Deviations above the expected Hamming distance of an angle that a query's radius covers, at least.
SPREAD = 2.0
#: Bits that a query's needed radius may exceed its own before it is asked again, if it has k rows.
SLACK = 8
#: Rows of an index block in the mean (some 1,500 bytes of a task's memory each, for 64 components), and blocks at least if there are 1,000 rows.
BLOCK_ROWS, LEAST_BLOCKS = 50_000, 12


def taking_part(df: DataFrame, vec: Column) -> Column:
    x = F.transform(vec, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    return vec.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    some = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    some = some.filter(F.col("vec_id").isNotNull() & F.coalesce(taking_part(some, F.col("v")), F.lit(False)))
    common = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return some.filter(F.size("v") == (common.n if common else 0))


def _some(vecs: DataFrame, rows: int, n: int, seed: int) -> DataFrame:
    """About ``rows`` of ``n`` rows, all if there are not more: a share by hash, the same in each run, whose size does not grow."""
    share = min(1.0, rows / max(n, 1))
    return vecs.filter(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def learn_rotations(x: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Columns of orthogonal rotations side by side, each learned from another start, until there are ``bits``."""
    d = x.shape[1]
    rng = np.random.Generator(np.random.PCG64(seed))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            b = np.where(x @ r >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(b.T @ x)
            r = (u @ v).T
        out.append(r)
    return np.hstack(out)[:, :bits]


def codes_of(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Codes as bytes (n, bits / 8)."""
    return np.packbits(x @ rotations >= 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(-1, dtype=np.int64)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In double precision, each row for itself: equal rows have equal scores."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def _ranges(starts: np.ndarray, order: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The members of some cells."""
    size = starts[cells + 1] - starts[cells]
    return order[np.repeat(starts[cells] - np.cumsum(size) + size, size) + np.arange(size.sum())]


class _Lists:
    """Distinct values, rising, and the numbers of the rows that have each."""

    def __init__(self, column: np.ndarray):
        self.order = np.argsort(column, kind="stable")
        ranked = column[self.order]
        new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(column) else np.zeros(0, np.int64)
        self.values, self.starts = ranked[new], np.append(new, len(column))

    def members(self, cells: np.ndarray) -> np.ndarray:
        return _ranges(self.starts, self.order, cells)


def pigeonhole(radius: int, parts: int) -> list[int]:
    """Radii of parts, of which one at least is met by any two codes within ``radius``; below 0: the part need not be looked at."""
    a, rest = divmod(radius, parts)
    return [a - (t > rest) for t in range(parts)]


class MultiIndex:
    """An index of each 32-bit substring of the codes: its distinct values, found by the cells of either half, and their rows."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        words = self.codes.view(np.uint32)
        self.lists = [_Lists(words[:, t]) for t in range(words.shape[1])]
        self.halves = [[_Lists((x.values >> np.uint32(s) & np.uint32(0xFFFF)).astype(np.uint16)) for s in (0, 16)] for x in self.lists]
        self.probed = 0

    def _near(self, t: int, value: np.uint32, radius: int) -> np.ndarray:
        """Numbers of the values at most ``radius`` bits away."""
        found = []
        for half, r, part in zip(self.halves[t], pigeonhole(radius, 2), (value & np.uint32(0xFFFF), value >> np.uint32(16))):
            if r >= 0:
                found.append(half.members(np.flatnonzero(np.bitwise_count(half.values ^ np.uint16(part)) <= r)))
        some = np.concatenate(found)
        return some[np.bitwise_count(self.lists[t].values[some] ^ value) <= radius]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is at most ``radius`` bits away, in order."""
        words = np.ascontiguousarray(code).view(np.uint32)
        hit = np.zeros(len(self.codes), bool)
        for t, r in enumerate(pigeonhole(radius, len(self.lists))):
            if r >= 0:
                hit[self.lists[t].members(self._near(t, words[t], r))] = True
        found = np.flatnonzero(hit)
        self.probed += len(found)
        return found[hamming(self.codes[found], code[None, :]) <= radius]


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _distinct(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id once, with the least of its vectors; sorted by id."""
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    first = np.concatenate(([True], ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
    return ids[first], x[first]


def _classes(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct vectors, and the sorted ids of each."""
    x = np.ascontiguousarray(x) + 0.0  # -0 becomes 0
    raw = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    parts = np.split(ids[order], np.cumsum(np.bincount(inverse))[:-1])
    return x[first], [np.sort(p) for p in parts]


def _expected(score, bits: int):
    """Mean and deviation of the Hamming distance of codes at this cosine, if bits were signs of independent projections; one bit is added to
    the variance, so that equal vectors have a deviation, too."""
    p = np.arccos(np.clip(score, -1, 1)) / np.pi
    return bits * p, np.sqrt(bits * p * (1 - p) + 1)


class Block:
    """The index of a block's rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotations: np.ndarray, k: int):
        self.x, self.members = _classes(*_distinct(ids, x))
        self.rotations, self.k = rotations, k
        self.codes = codes_of(self.x, rotations)
        self.index = MultiIndex(self.codes)

    def answer(self, asker: int, vec: np.ndarray, radius: int) -> list[tuple]:
        """(query_id, vec_id, score, away) of the nearest k rows within the radius, but the asker's own; below 0: brute force."""
        code, k = codes_of(vec[None, :], self.rotations)[0], self.k
        found = self.index.within(code, radius) if radius >= 0 else np.arange(len(self.x))
        if not len(found):
            return []
        score = cosines(self.x[found], vec)
        if len(found) > k + 1:  # ties with the (k + 1)-th stay
            enough = score >= np.partition(score, -(k + 1))[-(k + 1)]
            found, score = found[enough], score[enough]
        away = hamming(self.codes[found], code[None, :])
        some = sorted((-s, int(i), int(a)) for s, f, a in zip(score.tolist(), found, away) for i in self.members[f][: k + 1] if i != asker)
        return [(asker, i, -s, a) for s, i, a in some[:k]]


def _search_blocks(rotations, k: int):
    """Rows sorted by block: of each, its vectors (asks false), then its queries."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("away", pa.int32())])
        at, ids, vecs, block = None, [], [], None
        for batch in batches:
            numbers, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in _stretches(numbers, asks):
                some = batch.slice(a, b - a)
                if numbers[a] != at:
                    at, ids, vecs, block = numbers[a], [], [], None
                if not asks[a]:
                    ids.append(some.column(2).to_numpy())
                    vecs.append(_matrix(some.column(3)))
                    continue
                if block is None and ids:
                    block = Block(np.concatenate(ids), np.concatenate(vecs), rotations.value, k)
                    ids, vecs = [], []
                if block is not None:
                    out = [x for i, v, r in zip(some.column(2).to_pylist(), _matrix(some.column(3)), some.column(4).to_pylist()) for x in block.answer(i, v, r)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _stretches(numbers: np.ndarray, asks: np.ndarray):
    """Of sorted rows: from where to where block and kind stay the same."""
    if len(numbers):
        new = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
        yield from zip([0, *new.tolist()], [*new.tolist(), len(numbers)])


def _answers(vecs: DataFrame, queries: DataFrame, n_rows: int, rotations, k: int) -> DataFrame:
    """``queries`` have a radius each."""
    blocks = max(-(-n_rows // BLOCK_ROWS), LEAST_BLOCKS if n_rows > 1000 else 1)
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    rows = vecs.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long").alias("block"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(0).alias("radius"))
    asked = queries.select(numbers.alias("block"), F.lit(True).alias("asks"), "vec_id", "v", F.col("radius").cast("int").alias("radius"))
    sent = rows.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks", "vec_id")
    found = sent.mapInArrow(_search_blocks(rotations, k), "query_id long, vec_id long, score double, away int")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _asked_again(asked: DataFrame, found: DataFrame, spread: float, k: int, bits: int) -> DataFrame:
    """The queries whose radius was too small for their answer, with the next one."""
    last = found.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("worst"))
    p = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("worst")))) / float(np.pi)
    needed = F.floor(bits * p + spread * F.sqrt(bits * p * (1 - p) + 1)).cast("int")
    wider = F.greatest(2 * F.col("radius"), F.col("radius") + bits // 8)
    joined = asked.join(last.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").filter(F.col("radius") < bits)
    enough = F.when(needed > F.col("radius") + SLACK, needed).otherwise(F.col("radius"))
    to = F.least(F.lit(bits), F.when(F.coalesce("found", F.lit(0)) < k, wider).otherwise(enough)).cast("int")
    return joined.withColumn("to", to).filter(F.col("to") > F.col("radius")).select("vec_id", "v", F.col("to").alias("radius"))


def search(df: DataFrame, *, k: int = 5, every: int = 50, bits: int = BITS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by ``every``, the ``k`` nearest others."""
    spark = bounded(df.sparkSession)
    vecs = saved(vectors(df, id_col, vec_col), "ann-vectors")
    queries = saved(vecs.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    n = vecs.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = queries.count()
    sample = _some(vecs, TRAIN_ROWS, n, 1).orderBy("vec_id").collect() or vecs.limit(1).collect()
    rotations = spark.sparkContext.broadcast(learn_rotations(np.array([r.v for r in sample]), bits))
    few = saved(_some(queries, CALIBRATE, asked, 5).withColumn("radius", F.lit(-1)), "ann-calibration")
    true = _answers(vecs, few, n, rotations, k).select("score", "away").collect()
    away, score = np.array([r.away for r in true]), np.array([r.score for r in true])
    radius, spread = bits, SPREAD
    if true:
        radius = int(np.quantile(away, QUANTILE, method="higher"))
        mean, deviation = _expected(score, bits)
        spread = max(SPREAD, float(np.quantile((away - mean) / deviation, QUANTILE)))
    queries = saved(queries.withColumn("radius", F.lit(radius)), "ann-queries")
    columns = ("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    done = []
    while asked:
        found = saved(_answers(vecs, queries, n, rotations, k).select(*columns), "ann-found")
        again = saved(_asked_again(queries, found, spread, k, bits), "ann-queries")
        asked = again.count()
        done.append(found.join(again.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti") if asked else found)
        queries = again
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
