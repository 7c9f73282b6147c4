import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlode.llm import substrings as sub


def brute(rows, length=50):
    """Every window of every document in one table of the smallest id."""
    least = {}
    for d, t in rows:
        raw, d = (t or "").encode(), sub.LAST if d is None else d
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in rows:
        raw, key = (t or "").encode(), sub.LAST if d is None else d
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if least[raw[i : i + length]] < key:
                gone[i : i + length] = True
        gone = gone[:-1]
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.choice((48, 50, 51, 70, 400))], word()]
        rows.append((i, " ".join(parts)))
        if rng.random() < 0.2:
            rows.append((1000 + i, rng.choice(rows)[1]))
    rng.shuffle(rows)
    return rows + [(2000, None), (2001, ""), (2002, "short"), (2003, "a" * 500), (2004, "b" + "a" * 300), (2005, "ab" * 200), (2006, "ab" * 40), (2007, "\0" * 120), (2008, "\0" * 120 + "x")]


@pytest.mark.parametrize("seed,settings,more", [
    (1, {}, []),
    (2, {"HOT": 2, "MOST_ENTRIES": 300}, []),
    (3, {"HOT": 3, "SEGMENT": 200, "MOST_ENTRIES": 500}, []),
    (4, {"MOST_ENTRIES": 100, "BUCKET_SPANS": 40}, [(None, "a" * 60), (None, "zz" * 60), (None, "zz" * 60), (2003, "a" * 500), (2003, "other text that is long enough to count as one, see? yes")]),
])
def test_equals_brute_force(spark, monkeypatch, seed, settings, more):
    for k, v in settings.items():
        monkeypatch.setattr(sub, k, v)
    rows = corpus(seed) + more
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("clash")).repartition(3)
    got = sorted(((*r[:5], bytes(r[5])) for r in sub.dedup(df).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert sub.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deep_shallow_groups():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 2, 3000).astype(np.uint8)
    text[500:700] = text[100:300]
    text[2000:2100] = 0
    places = np.arange(len(text) - 50 + 1)
    groups = {}
    for p in places.tolist():
        groups.setdefault(text[p : p + 50].tobytes(), []).append(p)
    want = sorted(v for v in groups.values() if len(v) > 1)
    found, number = sub.equal_suffixes(text, places, 50, np.zeros(len(places), np.int64), np.zeros(len(places), bool))
    assert (np.diff(number) >= 0).all()
    assert sorted(sorted(found[number == n].tolist()) for n in set(number.tolist())) == want


def test_multikey_quicksort_orders():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 4000).astype(np.uint8)
    text[1000:1400] = text[200:600]
    raw = text.tobytes() + bytes(8)
    word = np.array([int.from_bytes(raw[i : i + 8], "big") for i in range(len(text))], np.uint64)
    places = rng.permutation(len(text) - 32)
    near = (places % 2).astype(np.int64)
    got, start, size = sub.multikey_quicksort(places, word, 32, near)
    keys = [(p % 2, raw[p : p + 32]) for p in places[got].tolist()]
    assert keys == sorted(keys) and len(start) > 100
    assert all(len(set(keys[a : a + n])) == 1 for a, n in zip(start.tolist(), size.tolist()))


def test_only_the_sorter_removes(spark):
    """With a sorter that finds nothing, nothing is removed: hashes only bring texts together."""
    none = lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64))
    df = spark.createDataFrame(corpus(5), "doc_id long, text string").repartition(3)
    assert sub.dedup(df, sort=none).agg(F.sum("n_removed")).first()[0] == 0
    assert sub.dedup(df).agg(F.sum("n_removed")).first()[0] > 1000


def test_blind_trie_orders():
    rng = random.Random(2)
    strings = ["".join(rng.choices("ab\0", k=9)).encode() for _ in range(400)]
    trie = sub.BlindTrie(9)
    for i, s in enumerate(strings):
        trie.add(s, i)
    got = [strings[g[0]] for g in trie.groups()]
    assert got == sorted(set(strings))
    assert all(len({strings[i] for i in g}) == 1 for g in trie.groups())
