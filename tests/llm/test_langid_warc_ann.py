import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlode.llm import ann, langid, registry, warc
from gramlode.llm.common import table

SF = "/root/testdata/sf0.01"


def test_langid_held_out_accuracy(spark):
    rows = registry.op1_langid(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_langid_edges(spark):
    rows = [(1, "the cat", "en"), (2, "le chat", "fr"), (3, None, "en"), (4, "", None), (5, "123 !?", "fr"), (6, "the " * 400_000, None), (7, "ж", None), (None, "the dog", "en"), (7, "ж", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[1][0] == got[6][0] == got[None][0] == "en" and got[2][0] == "fr" and got[7][0] in ("en", "fr")
    assert langid.identify(df, langid.train(df.filter("false"))).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.identify(df.filter("false"), model).count() == 0


def test_langid_batch_equals_plain():
    """The sparse product against a plain sum over every n-gram."""
    rng = np.random.default_rng(1)
    matrix = np.vstack([rng.normal(size=(langid.BUCKETS, 3)), np.zeros((1, 3))])
    texts = ["Hello, wörld", "", "a", "日本 Ж x", "été " * 50]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    tables = langid._tables()
    together, _ = langid.score_texts(data, offs, matrix, tables)
    for i, r in enumerate(raw):
        alone, _ = langid.score_texts(np.frombuffer(r, np.uint8), np.array([0, len(r)]), matrix, tables)
        assert np.allclose(together[i], alone[0])


def expected_pages(rows):
    best = {}
    for p, _, h in rows:
        raw = (h or "").encode()
        best[raw] = max([x for x in (best.get(raw), p) if x is not None], default=None)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        first = best[raw] is None or p == best[raw]
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else best[raw]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(3)
    rows = [(i, f"http://www.h{rng.randint(0, 5)}.example.com/p{rng.randint(0, 9)}?q={i % 4}", rng.choice([None, "", "same page", f"<p>é{i}\r\n\r\n</p>", "x" * 400_000])) for i in range(120)]
    return rows + [(119, None, "same page"), (119, "weird\r\nurl", "same page"), (None, "http://a", "same page"), (None, "http://[bad", "only here")]


def test_warc_round_trip(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 10)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("ts", F.lit("clash")).repartition(4)
    for most in (500_000, 0):  # broadcast, and joined by a shuffle
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        archives = warc.write_warc(df)
        rows = warc.history(archives).orderBy("range", "position").collect()
        assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=str) == expected_pages(pages)
        order = [(r.url_key, r.ts, r.page_id is not None, r.page_id or 0) for r in rows]
        assert order == sorted(order) and len({r["range"] for r in rows}) > 3
        last = {}
        for r in rows:  # the capture before, also if it ends another range
            assert r.prior_ts == last.get(r.url_key)
            last[r.url_key] = r.ts
    for name in warc.export(archives, str(tmp_path)):
        assert gzip.open(name).read().startswith(b"WARC/1.1\r\nWARC-Type: re")
    empty = df.filter("false")
    assert warc.history(warc.write_warc(empty)).count() == 0


def test_loser_tree():
    rng = random.Random(4)
    for k in range(0, 9):
        runs = [sorted([(f"u{rng.randint(0, 5)}", rng.randint(0, 3), rng.choice([None, 1, 2]), 0, "", "", None, str(i), n, 0) for n in range(rng.randint(0, 7))], key=warc._order) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(sum(runs, []), key=warc._order)


def brute(ids, x, k=5, every=50):
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            s = ann.cosines(x, v)
            out[i] = sorted((-a, j) for a, j in zip(s.tolist(), ids) if j != i)[:k]
    return out


def test_ann_recall(spark):
    rows = table(spark, SF, "embeddings").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    want = brute(ids, x)
    got = {}
    for r in registry.op9_ann(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({j for _, j in want[q]} & {j for _, j, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 6))
        assert all(abs(s - ann.cosines(x[[ids.index(j)]], x[ids.index(q)])[0]) < 1e-12 for _, j, s in found)


def test_ann_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000, None), (1001, [0.0] * 3), (1002, [float("nan"), 1.0, 1.0]), (1003, [None, 1.0, 1.0]), (1050, [1.0]), (None, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.0]), (2000, [-1.0, 0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and set(got) >= {0, 50, 100, 150, 200, 250}
    assert ann.search(df.filter("vec_id = 50")).count() == 0
    assert ann.search(df.filter("false")).count() == 0


def test_pigeonhole_finds_all_within_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (3000, 16)).astype(np.uint8)
    codes[:50] = codes[0] ^ (rng.random((50, 16)) < 0.3).astype(np.uint8)
    index = ann.MultiIndex(codes)
    for radius in (0, 3, 15, 17, 40, 50, 128):
        for q in codes[:10]:
            assert np.array_equal(index.within(q, radius), np.flatnonzero(ann.hamming(codes, q[None, :]) <= radius))


def test_ann_answers_outliers_among_dense_groups(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((100, 64))
    x = centres[rng.integers(0, 100, 4000)] + 0.01 * rng.standard_normal((4000, 64))
    alone = (np.arange(4000) % 400 == 0) | (np.arange(4000) % 40 == 7)
    x[alone] = rng.standard_normal((int(alone.sum()), 64))
    want = brute(range(4000), x, every=10)
    got = {}
    for r in ann.search(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), every=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert got.keys() == want.keys() and all(sorted(r for r, _ in v) == [1, 2, 3, 4, 5] for v in got.values())
    hits = [len({j for _, j in want[q]} & {j for _, j in got[q]}) / 5 for q in want if alone[q]]
    assert len(hits) == 10 and np.mean(hits) >= 0.9


def test_index_leaves_rows_out():
    """Clustered vectors: few rows are probed at a radius that holds 95 % of the true neighbours."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((200, 64))
    x = centres[rng.integers(0, 200, 20_000)] + 0.25 * rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = ann.learn_rotations(x[:4096])
    codes = ann.codes_of(x, r)
    ask = range(0, 20_000, 200)
    away = []
    for q in ask:
        near = np.argsort(-(x @ x[q]))
        away += ann.hamming(codes[near[near != q][:5]], codes[q][None, :]).tolist()
    radius = int(np.quantile(away, 0.95, method="higher"))
    index = ann.MultiIndex(codes)
    for q in ask:
        index.within(codes[q], radius)
    assert index.probed / (len(ask) * len(x)) < 0.1


def test_recall_of_the_tables_vectors(spark):
    import os

    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in ann.vectors(df).select("vec_id", F.col("v").alias("embedding")).collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {q: set(ids[sorted(np.flatnonzero(ids != q), key=lambda j: (-float(x[j] @ v), ids[j]))[:5]].tolist()) for q, v in zip(ids.tolist(), x) if q % 50 == 0}
    got = ann.search(df).collect()
    assert len(got) == 5 * len(want)
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.9 * len(got)


def plain_cells(text):
    """Cells of a text's n-grams, one at a time."""
    points = [ord(c) if ord(c) >= 0x600 else ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else 32 for c in text]
    out = []
    for i in range(len(points)):
        cell, blank = 0, True
        for n in range(1, 5):
            if i + n > len(points):
                break
            blank &= points[i + n - 1] == 32
            cell = (cell + points[i + n - 1] + n) * 0x9E3779B97F4A7C15 % 2**64
            if not blank:
                out.append(cell >> 48)
    return out


@pytest.mark.parametrize("languages", [3, 140])
def test_langid_equals_plain_bayes(spark, languages):
    """Training and prediction against plain counting; more languages than are scored together."""
    rng = random.Random(languages)
    letters = {f"l{i:03}": rng.sample("abcdefghijklmnopqrstuvwxyzäöüéñ日本語", 9) for i in range(languages)}
    text = lambda x: " ".join("".join(rng.choices(letters[x], k=rng.randint(2, 7))).title() for _ in range(12)) + "1!"
    rows = [(i, text(x), x) for i, x in enumerate(sorted(letters) * 2)] + [(9000, None, "l001"), (9001, "12 34", "l000"), (9002, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, langid.train(df)).collect()}
    counts = {x: {} for x in letters}
    for _, t, x in rows:
        if t is not None and x is not None:
            for c in plain_cells(t):
                counts[x][c] = counts[x].get(c, 0) + 1
    totals = {x: sum(c.values()) + langid.SMOOTH * langid.BUCKETS for x, c in counts.items()}
    for i, t, _ in rows[:: 1 if languages < 10 else 9] + rows[-3:]:
        if not t or not any(c.isalpha() for c in t):
            assert got[i] == ("und", 0.0)
            continue
        cells = plain_cells(t)
        sums = {x: sum(np.log((c.get(k, 0) + langid.SMOOTH) / totals[x]) for k in cells) for x, c in counts.items()}
        best = max(sums.values())
        assert sums[got[i][0]] > best - 1e-2
        assert abs(got[i][1] - 1 / sum(np.exp((v - best) / len(cells) ** 0.5) for v in sums.values())) < 1e-3
