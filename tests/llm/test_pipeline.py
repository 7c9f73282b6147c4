import random
import re
from collections import Counter

import public_tokenizers as P
import pytest

import corpus_pipeline as cp
from gramlode.llm import langid, mixing

from .test_bpe_media_mix import tiktoken_ids
from .test_ngram_join import brute


def fixture():
    rng = random.Random(8)
    words = {"en": "the of and to in is that was for it with as his on be at by".split(), "fr": "le la les des et une dans est que pour qui avec sur être où".split()}
    rows = []
    for i in range(160):
        lang = rng.choice(("en", "fr"))
        w = rng.choices(words[lang], k=rng.randint(12, 90))
        w = [x + rng.choice(("", "", "s", "e", "tion")) for x in w]
        rows.append((i, " ".join(w), lang, rng.choice(("a", "b", "c", None)), 5))
    for i in range(160, 200):
        _, t, lang, s, _ = rng.choice(rows[:160])
        w = t.split()
        if rng.random() < 0.6 and len(w) > 60:
            w[-1] = "changed"
        rows.append((i, " ".join(w), lang, s, 5))
    rows += [(300, None, "en", "a", 0), (301, "", None, "a", 0), (302, "12 34 !!", "en", "b", 8), (303, "the card of her is 4111111111111111 and the mail was for it a.b@c.de", "en", "b", 5)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("repeat", [False, True])
def test_stages_against_plain_ones(spark, repeat):
    rows = fixture() + (fixture()[:3] + [(None, "the of and to in is that was", "en", "a", 5)] * 2 if repeat else [])
    docs = spark.createDataFrame(rows, SCHEMA)
    one = cp.language_id(spark, docs, "")
    kept = [tuple(r) for r in one.collect()]
    assert one.columns == list(cp.COLUMNS)
    assert Counter((r[0], r[1]) for r in kept) == Counter((r[0], r[1]) for r in rows if r[1] and re.search("[a-z]", r[1]))
    two = cp.near_duplicates(spark, one, "")
    got = Counter((r.doc_id, r.text) for r in two.collect())
    numbered = [(n, r[1]) for n, r in enumerate(kept)]
    import gramlode.llm.ngram_join as nj

    assert nj.WORDS == 4
    groups = {}
    for n, _, c in brute5(numbered):
        groups.setdefault(c, []).append(n)
    want = Counter()
    for members in groups.values():
        best = min(members, key=lambda n: (kept[n][0] is None, kept[n][0] or 0))
        want[kept[best][0]] += 1
    assert Counter(k for k, _ in got.elements()) == want
    three = cp.personal_data(spark, two, "")
    for r in three.collect():
        assert "@" not in r.text and "4111111111111111" not in r.text
        assert ("[CARD]" in r.text and "[EMAIL]" in r.text and r.n_chars == len(r.text)) == (r.doc_id == 303)
    four = cp.mix_sources(spark, three, "")
    sizes = Counter()
    for r in three.collect():
        sizes[r.source] += len(r.text.split())
    goal = mixing.targets(list(sizes.items()))
    taken = Counter()
    for r in four.collect():
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - goal[s]) <= 95 for s in goal)
    assert max(Counter(r.doc_id for r in four.collect()).values()) <= 2 * (2 if repeat else 1)
    encode = tiktoken_ids()
    texts = {(r.doc_id, r.source): r.text for r in four.collect()}
    five = cp.tokens(spark, four, "").collect()
    assert len(five) == four.count()
    for r in five:
        assert r.round_trip and r.n_tokens == len(r.ids)
        if not repeat:
            assert r.ids == encode(texts[r.doc_id, r.source])


def brute5(rows):
    """Pairs of five-word sets, 0.8."""
    def sets(t):
        w = re.findall(r"[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    all_ = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if all_[i] and all_[j] and 100 * len(all_[i] & all_[j]) >= 80 * len(all_[i] | all_[j]):
                root[find(i)] = find(j)
    return [(rows[i][0], len(all_[i]), find(i)) for i in range(len(rows))]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0, name


def test_held_out_is_not_trained_on(spark):
    docs = spark.createDataFrame([(i, "the of and", "en", "a", 3) for i in range(50)], SCHEMA)
    assert 0 < docs.filter(langid.held_out()).count() < 50
    assert P.PATTERN


def test_extra_columns_and_nulls(spark):
    """Columns of a stage's own names, nulls in any column, a very long text."""
    from pyspark.sql import functions as F

    rows = [(1, "the of and to in " * 30_000, "en", None, None), (2, None, None, None, None), (None, "la les des et une dans est que", None, "a", 3), (3, "the of and mail a@b.cd", None, "a", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("found", "spans", "base", "copies", "size", "row", "score", "lang_pred", "n", "fp", "key", "words_of", "no_text", "a", "s"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs = docs.unionByName(docs.limit(1).withColumn("lang", F.lit("en")).withColumn("doc_id", F.lit(9).cast("long")).withColumn("text", F.lit("the and of to")))
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == list(cp.COLUMNS)
    kept = {r.doc_id: r for r in docs.collect()}
    assert kept.keys() <= {1, None, 3, 9} and 1 in kept
    assert cp.tokens(spark, docs, "").filter("not round_trip").count() == 0
