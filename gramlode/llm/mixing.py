"""Mixing sources to target weights by entropy balancing.

Each document gets a rate of 0 to 2 copies. The rates are those of least relative entropy to a base measure among all that meet the token
constraints, one for each source: its documents' expected words are its target. Each copy, of two at most, is tossed by itself, and the base
measure gives it odds of exp(b * z), z the document's logarithmic size and b a tilt towards longer documents that is given. Minimising the sum of
p log(p / q) + (1 - p) log((1 - p) / (1 - q)) by words tilts these odds exponentially, by the multiplier a of the source's constraint:
rate = 2 / (1 + exp(-(a + b * z))). (With one toss without a bound the form would be exp(a + b * z); the bound of 2 copies makes it this one.)
The dual is convex in a; each source has one constraint, so its Hessian is diagonal and a Newton step for all sources at once is one distributed sum
over documents. Rates become copies by
sequential Poisson sampling: a document's extra copy is taken in the order of hash / fraction (as hash / (hash + fraction), below 1) until its source's target is met, where
the border is found by refining histograms, so that no source is ever sorted or gathered as a whole.

A null text has size 0, a null source is a source of its own, last in order. Repeated rows share a hash and are
taken together. An empty table gives an empty result; a source without words takes nothing. Extra columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlode.llm.common import bounded, saved, text_chunks, word_bounds
from gramlode.operators.index import dense_ids

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Tilt towards long documents, Newton steps, cells of a histogram and how often it is refined.
TILT, STEPS, CELLS, LEVELS = 0.25, 30, 1024, 3
#: Sources that are solved together.
MOST_SOURCES = 100_000


def _sizes(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for rows, data, offs in text_chunks(batches, "words_of"):
        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(word_bounds(data, offs)[2], pa.int64())], names=[*rows.schema.names[:-1], "size"])


def word_sizes(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` and the number of words."""
    bounded(docs.sparkSession)
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("words_of")).mapInArrow(_sizes, f"{types}, size long")


def targets(sources: list[tuple], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Target of each (source, size): shares by weight; a source stops at ``most`` times its size and leaves the rest to the others."""
    order = sorted(sources, key=lambda s: (s[0] is None, s[0]))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, out = dict(order), {}
    open_, left = [s for s, _ in order], share * sum(size.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(most * size[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
    return {s: out[s] for s, _ in order}


def _rate(a: Column, tilt: float, most: float = MOST) -> Column:
    return most / (1 + F.exp(-(a + tilt * F.log1p(F.col("size").cast("double")))))


def _targets(by_source: DataFrame, weights, share: float, most: float) -> DataFrame:
    """targets() for any number of sources: (source, source_size, target). A source is full where the open ones' share of a unit of weight passes its
    limit; the share is summed by the executors until no other is full."""
    spark = by_source.sparkSession
    ranked = dense_ids(by_source.filter("source is not null").withColumnRenamed("source", "path")).select(F.col("path").alias("source"), "source_size", F.col("dense_id").alias("place"))
    last = by_source.filter("source is null").select("source", "source_size", F.lit(ranked.count()).cast("long").alias("place"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = saved(ranked.unionByName(last).withColumn("weight", weight), "mix-weights")
    limit = most * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0]
    unit, full = 0.0, -1
    while True:
        is_full = F.lit(unit) * F.col("weight") > limit if full >= 0 else F.lit(False)
        n, taken, open_ = ranked.agg(F.count(F.when(is_full, 1)), F.sum(F.when(is_full, limit).otherwise(0.0)), F.sum(F.when(~is_full, F.col("weight")).otherwise(0.0))).first()
        if n == full or not open_:
            return ranked.select("source", "source_size", F.when(is_full, limit).otherwise(F.lit(unit) * F.col("weight")).alias("target"))
        unit, full = (share * total - taken) / open_, n


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST, tilt: float = TILT, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies and taken of each document, and columns to ``keep``.

    Up to MOST_SOURCES sources are solved together, their rows held by the driver and broadcast; with more, targets are shared out by the executors and
    sources are solved in groups of that size, by hash: after the targets, no source depends on another."""
    spark = docs.sparkSession
    docs = docs.withColumn("source", F.col("source").cast("string"))
    sized = saved(word_sizes(docs), "mix-sizes")
    rows = word_sizes(docs, ("doc_id", "source", *(c for c in keep if c not in ("doc_id", "source")))) if keep else sized
    by_source = saved(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    n = by_source.count()
    solve = {"most": most, "tilt": tilt, "seed": seed, "keep": keep}
    if n <= MOST_SOURCES:
        listed = [(r.source, r.source_size) for r in by_source.collect()]
        goal = targets(listed, weights, share, most)
        return _solved(spark, sized, rows, goal, dict(listed), **solve)
    told = saved(_targets(by_source, weights, share, most), "mix-targets")
    groups = -(-2 * n // MOST_SOURCES)
    rows = saved(rows, "mix-rows") if keep else rows
    out = []
    for k in range(groups):
        here = F.pmod(F.xxhash64("source"), F.lit(groups)) == k
        some = told.filter(here).collect()
        out.append(_solved(spark, sized.filter(here), rows.filter(here), {r.source: r.target for r in some}, {r.source: r.source_size for r in some}, **solve))
    return reduce(DataFrame.unionByName, out)


def _solved(spark, sized: DataFrame, rows: DataFrame, goal: dict, size_of: dict, *, most: float, tilt: float, seed: int, keep: tuple[str, ...]) -> DataFrame:
    """The mix of some sources."""
    a = {s: round(x, 9) for s, x in _multipliers(sized, goal, size_of, most, tilt).items()}  # sums in another order must not change rates
    info = F.broadcast(spark.createDataFrame([(s, size_of[s], float(goal[s]), a[s]) for s in goal], "s string, source_size long, target double, a double"))

    def rated(rows: DataFrame) -> DataFrame:
        toss = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
        rate = F.when(F.col("a") >= 1e3, F.lit(float(most))).when(F.col("a") <= -1e3, F.lit(0.0)).otherwise(_rate(F.col("a"), tilt, most))
        out = rows.join(info, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate).withColumn("whole", F.floor("rate"))
        part = F.col("rate") - F.col("whole")
        return out.withColumn("key", F.when(part > 0, toss / (toss + part)))

    line = F.broadcast(_border(rated(sized), goal))
    extra = F.when(F.col("key").isNotNull() & (F.col("key") < F.col("line")), 1).otherwise(0)
    out = rated(rows).join(line, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("copies", (F.col("whole") + extra).cast("int"))
    return out.select(*dict.fromkeys(("doc_id", "source", *keep)), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _multipliers(sized: DataFrame, goal: dict, size_of: dict, most: float, tilt: float) -> dict:
    """Newton's steps on the dual of each source, safeguarded by bisection. Documents of equal source and size have equal rates, so their
    numbers are enough. Goals at 0 or at the limit have no finite multiplier: -1000 and 1000 stand for it."""
    spark = sized.sparkSession
    counts = saved(sized.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    a = {s: 0.0 for s in goal if 0 < goal[s] < most * size_of[s] * (1 - 1e-9)}
    bounds = {s: (-60.0, 60.0) for s in a}
    moving = set(a)
    for _ in range(STEPS):
        if not moving:
            break
        now = spark.createDataFrame([(s, a[s]) for s in sorted(moving, key=lambda s: (s is None, s or ""))], "s string, a double")
        rate = _rate(F.col("a"), tilt, most)
        words = F.col("n") * F.col("size")
        sums = counts.join(F.broadcast(now), F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(F.sum(words * rate).alias("f"), F.sum(words * rate * (1 - rate / most)).alias("g"))
        for r in sums.collect():
            s, gap = r.source, r.f - goal[r.source]
            if abs(gap) <= 1e-6 * max(1.0, goal[s]):
                moving.discard(s)
                continue
            low, high = bounds[s]
            low, high = (low, a[s]) if gap > 0 else (a[s], high)
            step = a[s] - gap / r.g if r.g > 0 else (low + high) / 2
            a[s] = step if low < step < high else (low + high) / 2
            bounds[s] = (low, high)
    return {s: a.get(s, -1e3 if goal[s] <= 0 else 1e3) for s in goal}


def _border(rated: DataFrame, goal: dict) -> DataFrame:
    """The key below which each source takes extra copies: histograms of the words by key, refined where the target falls.
    Each has CELLS rows a source at most, summed before the shuffle."""
    spark = rated.sparkSession
    base = {r.source: r.w for r in rated.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("w")).collect()}
    low, width, need = {}, {}, {}
    for s in base:
        low[s], width[s], need[s] = 0.0, 1.0, goal[s] - base[s]
    for level in range(LEVELS):
        now = F.broadcast(spark.createDataFrame([(s, low[s], width[s]) for s in low], "s string, low double, width double"))
        cell = F.floor((F.col("key") - F.col("low")) / F.col("width") * CELLS)
        cells = (
            rated.filter("key is not null and size > 0").join(now, F.col("source").eqNullSafe(F.col("s")))
            .withColumn("cell", cell).filter((F.col("cell") >= 0) & (F.col("cell") < CELLS))
            .groupBy("source", "cell").agg(F.sum("size").alias("w"))
        )
        run = Window.partitionBy("source").orderBy("cell")
        wants = F.broadcast(spark.createDataFrame([(s, float(need[s])) for s in low], "s string, need double"))
        summed = cells.withColumn("upto", F.sum("w").over(run)).join(wants, F.col("source").eqNullSafe(F.col("s")))
        hit = summed.filter(F.col("upto") - F.col("w") < F.col("need")).groupBy("source").agg(F.max(F.struct("cell", "w", "upto")).alias("last"))
        for r in hit.collect():
            s, cell_, w, upto = r.source, r["last"].cell, r["last"].w, r["last"].upto
            if upto <= need[s]:  # all cells fit
                low[s] += width[s] * (cell_ + 1) / CELLS
                need[s] -= upto
                width[s] = 1e-12
            else:
                low[s] += width[s] * cell_ / CELLS
                need[s] -= upto - w
                width[s] /= CELLS
                if w - need[s] < need[s] and level == LEVELS - 1:  # nearer with the border cell than without
                    low[s] += width[s]
    return spark.createDataFrame([(s, low[s]) for s in low], "s string, line double")
