"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become lower-cased code points with everything but letters turned into spaces; n-grams of 1 to 4 code points are hashed into
BUCKETS cells. Training sums counts by language and cell in Spark; the matrix of log probabilities (BUCKETS x languages, a fixed size)
is broadcast, and documents are scored in batches as sparse rows times that matrix. All languages are as likely before the text is seen. Any number of
languages will do; each adds 256 KB to the matrix, which is in single precision, and texts are scored in blocks of languages.

A null text, or one without a letter, is ``und`` with score 0. Documents without a language do not train; if none trains, all
are ``und``. Ties go to the language first in code point order. Repeated rows count as often as they occur, an empty table
gives an empty result, extra columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import bounded, text_chunks

BUCKETS, ORDERS, SMOOTH = 1 << 16, (1, 2, 3, 4), 0.5
#: Documents of a language that train, in the mean: a sample by hash, documented bound.
TRAIN_DOCS = 4000
#: Languages that are counted, and scored, together.
COUNTED, SCORED = 16, 128
BLOCK = 1 << 19


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 0x600: the lower-case one or a space, and whether it is a letter. Others stand for themselves."""
    chars = [chr(i) for i in range(0x600)]
    letter = np.array([c.isalpha() for c in chars])
    low = np.array([ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else 32 for c in chars], np.uint32)
    return low, letter


def features(data: np.ndarray, offs: np.ndarray, tables) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of n-grams: (cell or BUCKETS for none, text number) in text order, of at most BLOCK positions an order."""
    low, _ = tables
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    ends = lead[offs]
    points = np.where(points < 0x600, low[np.minimum(points, 0x5FF)], points)
    for at in range(0, len(points), BLOCK):
        to = min(at + BLOCK, len(points))
        pos = np.arange(at, to)
        doc = np.searchsorted(ends, pos, "right") - 1
        room = ends[doc + 1] - pos
        cells = np.zeros(to - at, np.uint64)
        blank = np.ones(to - at, bool)
        for n in range(1, max(ORDERS) + 1):
            nxt = np.full(to - at, 32, np.uint32)
            part = points[at + n - 1 : to + n - 1]
            nxt[: len(part)] = part
            blank &= nxt == 32
            cells = (cells + nxt + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            if n in ORDERS:
                cell = (cells >> np.uint64(48)).astype(np.int64)
                cell[blank | (room < n)] = BUCKETS
                yield cell, doc


def has_letter(data: np.ndarray, offs: np.ndarray, tables) -> np.ndarray:
    _, letter = tables
    ascii_letter = np.concatenate(([0], np.cumsum(letter[np.minimum(data, 127)] & (data < 128))))
    found = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offs) > 0)):  # none in ASCII: look at each character
        found[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _counts(batches: Iterator) -> Iterator:
    """Sums by language number and cell; those of more than COUNTED languages are sent on in parts."""
    import pyarrow as pa

    tables = _tables()
    totals: dict[int, np.ndarray] = {}

    def sent():
        for name, row in totals.items():
            cells = np.flatnonzero(row[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), name, np.int32)), pa.array(cells, pa.int32()), pa.array(row[cells], pa.int64())], names=["lang", "cell", "n"])
        totals.clear()

    for rows, data, offs in text_chunks(batches, budget=1 << 20):
        names, number = np.unique(rows.column(0).to_numpy(), return_inverse=True)
        blocks = list(features(data, offs, tables))
        for at in range(0, len(names), COUNTED):
            some = names[at : at + COUNTED]
            got = np.zeros((len(some), BUCKETS + 1), np.int64)
            for cell, doc in blocks:
                own = number[doc] - at
                here = (own >= 0) & (own < len(some)) if len(names) > COUNTED else slice(None)
                got += np.bincount(own[here] * (BUCKETS + 1) + cell[here], minlength=got.size).reshape(got.shape)
            if len(totals) + len(some) > 2 * COUNTED:
                yield from sent()
            for name, row in zip(some.tolist(), got):
                totals[name] = totals[name] + row if name in totals else row
    yield from sent()


def held_out() -> Column:
    """A fifth of the documents, by their ids; a null id is written as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(labelled: DataFrame, most_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities, from (doc_id, text, lang). Of a language with more than ``most_docs`` documents, a share by hash
    trains; what reaches the driver are languages x BUCKETS sums at most."""
    labelled = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    langs = sorted(sizes)
    spark = bounded(labelled.sparkSession)
    cut = F.broadcast(spark.createDataFrame([(x, i, int(min(1.0, most_docs / sizes[x]) * (1 << 30))) for i, x in enumerate(langs)], "lang string, number int, cut long"))
    chosen = labelled.join(cut, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("cut"))
    counts = chosen.select("number", F.col("text").cast("string").alias("text")).mapInArrow(_counts, "lang int, cell int, n long")
    table = counts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.full((BUCKETS + 1, len(langs)), SMOOTH, np.float32)
    matrix[table["cell"].to_numpy(), table["lang"].to_numpy()] += table["n"].to_numpy()
    matrix[BUCKETS] = 0
    for i in range(len(langs)):
        column = matrix[:BUCKETS, i].astype(float)
        matrix[:BUCKETS, i] = np.log(column / column.sum())
    return langs, matrix


def score_texts(data: np.ndarray, offs: np.ndarray, matrix: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log probabilities of each text (sparse rows times the matrix), and their numbers of n-grams."""
    n = len(offs) - 1
    sums, counts = np.zeros((n, matrix.shape[1])), np.zeros(n)
    step = max(4096, (1 << 21) // max(1, min(SCORED, matrix.shape[1])))  # bounds the memory whatever the number of languages
    for cells, docs in features(data, offs, tables):
        for at in range(0, len(cells), step):
            cell, doc = cells[at : at + step], docs[at : at + step]
            new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            for k in range(0, matrix.shape[1], SCORED):
                sums[doc[new], k : k + SCORED] += np.add.reduceat(matrix[:, k : k + SCORED][cell], new, axis=0, dtype=float)
            counts[doc[new]] += np.add.reduceat((cell < BUCKETS).astype(float), new)
    return sums, counts


def _predict(shared, langs: list[str], keep: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tables, matrix = _tables(), shared.value
        for rows, data, offs in text_chunks(batches, budget=1 << 20):
            n = len(offs) - 1
            letters = has_letter(data, offs, tables)
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if langs:
                sums, counts = score_texts(data, offs, matrix, tables)
                best = sums.argmax(1)
                # the posterior of a long text is 0 or 1; by the root of its length it still tells sure from unsure
                odds = (sums - sums.max(1, keepdims=True)) / np.sqrt(np.maximum(counts, 1))[:, None]
                score = 1 / np.exp(odds).sum(1)
            known = letters & bool(langs)
            pred = [langs[b] if k else "und" for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:keep], pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))], names=[*rows.schema.names[:keep], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score of each document; only the text enters the prediction."""
    langs, matrix = model
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    kept = [docs[c].alias(f"c{i}") for i, c in enumerate(keep)]
    types = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = docs.select(*kept, docs["text"].cast("string").alias("text")).mapInArrow(_predict(shared, langs, len(keep)), f"{types}, lang_pred string, score double")
    return out.toDF(*keep, "lang_pred", "score")
