import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlode.llm import ngram_join as nj


def shingles(text, n=4):
    w = re.findall(r"[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, similar=85):
    """(row number to component) by looking at every pair."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        ids = [x for x in (best.get(find(i)), d) if x is not None]
        best[find(i)] = min(ids) if ids else None
    return sorted(((d, len(s), best[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "The"] * 30
    rows = []
    base = [" ".join(rng.choices(vocab, k=rng.choice((3, 5, 8, 30, 60, 200)))) for _ in range(25)]
    common = " ".join(rng.choices(vocab, k=25))
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        text = " ".join(w)
        rows.append((i + 10, f"{common} {text}" if rng.random() < 0.3 else text.replace(" ", rng.choice((" ", "\n", "\t ", " "))) if rng.random() < 0.2 else text))
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "Ü x"), (5, "ü x"), (6, "ONE two"), (7, "one TWO"), (None, "one two"), (None, rows[0][1]), (8, "a\x0bb c d e " * 3000)]


@pytest.mark.parametrize("seed,settings", [(1, {}), (2, {"HOT": 3, "BATCH_DOCS": 40, "MOST_ENTRIES": 500}), (3, {"HOT": 2, "MOST_ENTRIES": 900, "SKIPPED": 2}), (4, {"PIVOTS": 1})])
def test_components_equal_brute_force(spark, monkeypatch, seed, settings):
    for k, v in settings.items():
        monkeypatch.setattr(nj, k, v)
    rows = corpus(seed)
    if seed in (2, 4):  # ids are unique: copies are left out of the index
        rows = [(d, t) for d, t in rows if d is not None]
    if seed == 1:
        rows += rows[:5]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.join(df).collect()), key=str)
    want = brute(rows)
    assert got == want


def test_group_of_near_copies(spark):
    """Chains and stars: members that are linked to few others only."""
    rng = random.Random(9)
    w = [f"x{i}" for i in range(80)]
    rows = [(0, " ".join(w))]
    for i in range(1, 120):
        v = rows[rng.randrange(len(rows))][1].split()
        for _ in range(2):
            v[rng.randrange(80)] = f"y{rng.randrange(30)}"
        rows.append((i, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.join(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.join(df).count() == 0
    df = spark.createDataFrame([(3, None), (4, "")], "doc_id long, text string")
    assert sorted(map(tuple, nj.join(df).collect())) == [(3, 0, 3), (4, 0, 4)]


def test_suffix_bound_and_packing():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 80, rng.integers(0, 60))) for _ in range(2))
        true = len(np.setxor1d(a, b))
        for most in (0, 3, 10, 100):
            assert nj.suffix_differs(a, b, most) <= true
    x = np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64))
    assert np.array_equal(nj.unpacked(nj.packed_bytes(x)), x)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_brute_force(spark, seed):
    rows = corpus(seed, 160)
    if seed == 1:
        rows += rows[:5]  # repeated rows
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: a and b and 100 * len(a & b) >= 85 * len(a | b)
    want = sorted(((d, len(s), sum(bool(near(s, o)) for j, o in enumerate(sets) if j != i)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in nj.link_counts(df).collect()), key=str) == want
    distinct = {frozenset(s) for s in sets}
    pairs = sum(bool(near(a, b)) for a in distinct for b in distinct if a != b) // 2
    got = nj.links(df)[1].collect()
    assert pairs > 10 and len(got) == pairs == len({frozenset((bytes(r.fp_a), bytes(r.fp_b))) for r in got})
    assert nj.link_counts(df.filter("doc_id = 1")).first().n_links == 0
