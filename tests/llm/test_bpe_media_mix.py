import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from gramlode.llm import bpe, media, mixing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "a", "Hello  world's 123\n\n x", "é" * 700, "a" * 3000, "ab" * 900 + "\x85\xa0 \x1c　z", "日本語のテキスト 𝔘𝔫𝔦", "�\x00\x01 !!!" * 50, " " * 500 + "x", "x" + "\n" * 300]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["the", "of", "Straße", "naïve", "12345", "...", "\n", "foo_bar", "don't"]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(40)] + TEXTS[:3]
    return texts, spark.createDataFrame([(i, t, "s", 7) for i, t in enumerate(texts)], "doc_id long, text string, source string, ids int").repartition(3)


def tiktoken_ids():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_bpe_equals_tiktoken(docs):
    texts, df = docs
    encode = tiktoken_ids()
    rows = {r.doc_id: r for r in bpe.bpe_encode(df, RANKS, P.PATTERN).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i].ids == encode(t or ""), t
        assert bytes(rows[i].decoded) == (t or "").encode()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_monoid_random_bytes():
    m = bpe.Monoid(bpe.read_ranks(RANKS))
    rng = random.Random(1)
    for _ in range(400):
        x = bytes(rng.choice(b"ab ctheion\xc3\xa9") for _ in range(rng.randint(0, 60)))
        assert m.encode(x) == (m.window(x) if x else [])
        assert m.decode(m.encode(x)) == x


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert bpe.bpe_encode(none, RANKS, P.PATTERN).count() == 0
    assert media.media_columns(none).count() == 0
    assert mixing.mix(none).count() == 0


def test_media_round_trip(docs):
    texts, df = docs
    rows = {r.doc_id: r for r in media.media_columns(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(full))
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest()
        assert r.media_bytes == len(r.media) and bytes(r.media[:4]) == b"RIFF"
        assert r.shots[0] == 0
    assert rows[1].media_sha256 == rows[0].media_sha256


def test_media_every_difference():
    import numpy as np

    data = np.random.default_rng(3).integers(0, 256, 576 * 300 + 5).astype(np.uint8)
    files = media.write_avis(data, np.array([0, 0, 577, len(data)]))
    samples, first = media.read_avis(files)
    back = [samples[a:b].tobytes() for a, b in zip(first, first[1:])]
    assert b"".join(x[:n] for x, n in zip(back, (0, 577, len(data) - 577))) == data.tobytes()


def test_media_cuts_shots(spark):
    df = spark.createDataFrame([(1, "a" * 5760 + "\x01" * 5760)], "doc_id int, text string")
    out = media.media_columns(df)
    assert out.first().shots == [0, 10]
    assert [(r.start_s, r.end_s) for r in media.clips(out).orderBy("clip").collect()] == [(0.0, 0.4), (0.4, 0.8)]


def test_targets():
    got = mixing.targets([("a", 100), ("b", 1000), (None, 400), ("c", 0)])
    assert got["a"] == 200 and got["c"] == 0 and abs(sum(got.values()) - 2250) < 1e-6
    assert abs(got["b"] / got[None] - 1 / 3) < 1e-9 or got[None] == 800


def test_mix_reaches_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["x", "y", "z", None, "y"])) for i in range(3000)] + [(9999, None, "x"), (9999, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", __import__("pyspark").sql.functions.lit("clash"))
    a, b = mixing.mix(df).collect(), mixing.mix(df.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.size)
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
    assert len(a) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in a)
    for s in ("x", "y", "z", None):
        own = [r for r in a if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 61
        assert own[0].source_size == sum(r.size for r in own)


@pytest.mark.parametrize("together", [100_000, 4])
def test_mix_rates_equal_bisection(spark, monkeypatch, together):
    """Targets and rates of each source against plain ones; also where sources are solved in groups."""
    import math

    monkeypatch.setattr(mixing, "MOST_SOURCES", together)
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 3, 10, 60))), rng.choice(["a", "b", "ü", "Z", "c c", "tiny", "d", None])) for i in range(900)] + [(5000, "x " * 4000, "b"), (5001, None, "e"), (5002, "x", "e")]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()}
    size = {d: len((t or "").split()) for d, t, _ in rows}
    sums = {}
    for d, _, s in rows:
        sums[s] = sums.get(s, 0) + size[d]
    goal = mixing.targets(list(sums.items()))
    assert len(got) == len(rows) and abs(sum(goal.values()) - 1.5 * sum(sums.values())) < 1e-6
    for s in sums:
        own = [d for d, _, x in rows if x == s]
        rate = lambda a, n: 2 / (1 + math.exp(-(a + mixing.TILT * math.log1p(n))))
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(size[d] * rate(mid, size[d]) for d in own) < goal[s] else (low, mid)
        for d in own:
            assert abs(got[d].target - goal[s]) < 1e-6 and got[d].source_size == sums[s] and got[d].copies in (0, 1, 2)
            assert abs(got[d].rate - (2.0 if goal[s] >= 2 * sums[s] else rate(low, size[d]))) < 1e-4
