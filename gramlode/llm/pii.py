"""Personal data: candidate spans, boosted trees, calibrated thresholds. All of the main path are SQL expressions on one row.

Base spans (email, ip, card, phone) are found by fixed patterns and rules and always stay. Text of base matches that fail their rule is gone
through again by high-recall generators, which may overlap: cards and phone numbers that run into each other, local
phone numbers, spelled-out email addresses. Boosted trees score these candidates by format and context, and a threshold for
each kind, calibrated for precision on held-out examples, selects the spans that are added.

The trees are trained on synthetic labelled texts (EXAMPLES of them, a fixed number), through the same expressions, once in a session; the
main path then holds them as nested CASE expressions. Positions are code points, ends exclusive. A null text is empty and has no
span. Every row is treated alone, so repeated rows give equal results; an empty table gives an empty one; extra columns are left aside.

Patterns have possessive quantifiers and start only where a run of their characters starts, so that matching is linear in the text;
what they match is what the plain patterns match, leftmost first.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Base patterns in linear form. A new match may begin right behind the last one.
BASE = {
    EMAIL: r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Runs of the characters of which ip, card and phone matches consist, seven at least (the shortest ip).
RUN = r"(?<![0-9\x20().+-])(?=[\x20().+-]*+[0-9])[0-9\x20().+-]{7,}+"
MAY_RUN = r"[0-9+(][0-9\x20().+-]{6}"
#: Generators: kind and pattern. They go through runs from which valid base matches of the kind are blanked out.
GENERATORS = (
    (CARD, r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    (CARD, r"(?<![0-9])3[47][0-9]{2}([\x20-]?)[0-9]{6}\1[0-9]{5}(?![0-9])"),
    (PHONE, r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    (PHONE, r"(?<![0-9+])(?<!\+[0-9]\x20)(?<!\+[0-9]{2}\x20)\(?[0-9]{3}(?:\)\x20?|[.-]|\x20)[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
)
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)[A-Za-z0-9-]{2,63}+){1,4}"
#: Ends of addresses that tell a domain from two words round a missing space.
DOMAINS = r"(?i)(?:com|org|net|edu|gov|info|io|example|de|fr|es|uk|eu)$"
WORDS = ((1, "phone|tel|call|mobile|fax|reach"), (2, "card|visa|credit|pay|amex"), (3, "order|invoice|ref|serial|isbn|part|version|ticket|sku|id"), (4, "mail|contact|write"))
FEATURES = ("kind", "generator", "digits", "length", "luhn", "marks", "first", "variety", "left", "right", "word", "domain")
EXAMPLES, TREES, DEPTH, RATE, PRECISION = 3000, 24, 3, 0.3, 0.995
CONTEXT = 24


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(pieces: Column, hits: Column) -> Column:
    """Where each hit begins: sums of the lengths before it, in blocks of 256, so that no sum is over the whole array."""
    n, block = F.size(hits), 256
    steps = F.zip_with(F.slice(pieces, 1, n), hits, lambda a, b: F.length(a) + F.length(b))

    def with_steps(s: Column) -> Column:
        count = F.ceil(n / block).cast("int")
        add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
        blocks = F.when(n > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        sums = F.transform(blocks, lambda b: add(F.slice(s, b * block + 1, block)))
        return let(sums, lambda t: let(F.transform(t, lambda _, b: add(F.slice(t, 1, b))), lambda before: F.transform(hits, lambda _, i: F.get(before, F.floor(i / block).cast("int")) + add(F.slice(s, F.floor(i / block).cast("int") * block + 1, i % block)) + F.length(F.get(pieces, i)))))

    return let(steps, with_steps)


def located(text: Column, pattern: str) -> Column:
    """array<struct<at, hit>> of a pattern's matches, in order."""
    split = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return let(split, lambda s: F.when(F.size(s.hits) == 0, F.array().cast("array<struct<at:int,hit:string>>")).otherwise(F.arrays_zip(_starts(s.pieces, s.hits).alias("at"), s.hits.alias("hit"))))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """For strings of up to 19 digits; longer ones fail."""
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0))
    return F.when(F.length(digits).between(1, 19), total % 10 == 0).otherwise(F.lit(False))


def valid(kind: int, hit: Column) -> Column:
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"  # after its leading zeros
        return F.rlike(hit, F.lit(rf"^(?:{part}\.){{3}}{part}$"))
    n = F.length(_digits(hit))
    if kind == PHONE:
        return n.between(10, 15)
    return F.when(n.between(14, 19), luhn(_digits(hit))).otherwise(F.lit(False))


def coded(start: Column, kind: int, length: Column) -> Column:
    """A span as one long, ordered by start, kind, length: 30, 2 and 31 bits."""
    return start.cast("long") * F.lit(1 << 33) + F.lit(kind << 31).cast("long") + length.cast("long")


def span_start(code: Column) -> Column:
    return F.shiftrightunsigned(code, 33).cast("int")


def span_kind(code: Column) -> Column:
    return F.shiftrightunsigned(code, 31).bitwiseAND(F.lit(3)).cast("int")


def span_length(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


NONE = "array<long>"


def _class(c: Column) -> Column:
    """Of one character or none: 0 none or space, 1 letter, 2 digit, 3 plus, 4 bracket, 5 other."""
    return F.when((c == "") | (c == " ") | (c == "\n") | c.isNull(), 0).when(F.rlike(c, F.lit(r"^\p{L}$")), 1).when(F.rlike(c, F.lit("^[0-9]$")), 2).when(c == "+", 3).when(F.rlike(c, F.lit(r"^[()\[\]]$")), 4).otherwise(5)


def _features(kind: int, generator: int, hit: Column, before: Column, after: Column) -> list[Column]:
    """One int for each of FEATURES."""

    def with_digits(d: Column) -> Column:
        word = reduce(lambda c, kw: F.when(F.rlike(before, F.lit(rf"(?i)(?<![a-z])(?:{kw[1]})s?\b[^0-9A-Za-z]*(?:[A-Za-z]+[^0-9A-Za-z]*)?$")), kw[0]).otherwise(c), WORDS, F.lit(0))
        variety = F.size(F.array_distinct(F.split(d, "")))
        return F.array(F.lit(kind), F.lit(generator), F.length(d), F.length(hit), F.when(F.length(d).between(12, 19), luhn(d).cast("int")).otherwise(0), F.length(F.regexp_replace(hit, r"[0-9A-Za-z]", "")), F.coalesce(F.try_element_at(F.split(d, ""), F.lit(1)).try_cast("int"), F.lit(0)), variety, _class(F.right(before, F.lit(1))), _class(F.left(after, F.lit(1))), word, F.rlike(hit, F.lit(DOMAINS)).cast("int"))

    return let(_digits(hit), with_digits)


CANDIDATE = "array<struct<code:long,features:array<int>>>"


def _generated(text: Column, run_at: Column, before: Column, after: Column, kinds) -> Column:
    """Candidates of a run (or, for spelled-out addresses, of a whole text), with their features."""
    def candidate(kind: int, number: int):
        def one(h: Column) -> Column:
            left = F.right(F.concat(before, F.substring(text, F.greatest(h["at"] - CONTEXT + 1, F.lit(1)), F.least(h["at"], F.lit(CONTEXT)))), F.lit(CONTEXT))
            right = F.left(F.concat(F.substring(text, h["at"] + F.length(h["hit"]) + 1, F.lit(1)), after), F.lit(1))
            return F.struct(coded(run_at + h["at"], kind, F.length(h["hit"])).alias("code"), _features(kind, number, h["hit"], left, right).alias("features"))

        return one

    return F.concat(*(F.transform(located(text, pattern), candidate(kind, number)) for number, (kind, pattern) in enumerate(kinds)))


def _run_found(run: Column) -> Column:
    """Of one run (at, hit, before, after): base spans of each kind, and candidates in what base matches leave."""
    text = run["hit"]

    def of_kind(kind: int) -> Column:
        patterns = [(n, g) for n, g in enumerate(GENERATORS) if g[0] == kind]

        def with_hits(hits: Column) -> Column:
            good = F.filter(hits, lambda h: valid(kind, h["hit"]))
            base = F.transform(good, lambda h: coded(run["at"] + h["at"], kind, F.length(h["hit"])))
            if not patterns:
                return F.struct(base.alias("base"), F.array().cast(CANDIDATE).alias("more"))

            def blanked(g: Column) -> Column:
                ends = F.transform(g, lambda h: h["at"] + F.length(h["hit"]))
                gap = F.transform(g, lambda h, i: F.concat(F.substring(text, F.coalesce(F.get(ends, i - 1), F.lit(0)) + 1, h["at"] - F.coalesce(F.get(ends, i - 1), F.lit(0))), F.repeat(F.lit("x"), F.length(h["hit"]))))
                rest = F.substring(text, F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + 1, F.length(text))
                return F.when(F.size(g) == 0, text).otherwise(F.concat(F.array_join(gap, ""), rest))

            found = let(F.struct(let(good, blanked).alias("t")), lambda s: _generated(s.t, run["at"], run["before"], run["after"], [g for _, g in patterns]))
            return F.struct(base.alias("base"), found.alias("more"))

        return let(located(text, BASE[kind]), with_hits)

    return let(F.struct(*(of_kind(k).alias(KINDS[k]) for k in (IP, CARD, PHONE))), lambda s: F.struct(F.concat(*(s[KINDS[k]]["base"] for k in (IP, CARD, PHONE))).alias("base"), F.concat(*(s[KINDS[k]]["more"] for k in (IP, CARD, PHONE))).alias("more")))


FOUND = f"struct<base:{NONE},more:{CANDIDATE}>"


def candidates(text: Column) -> Column:
    """struct<base: coded spans that stay, more: candidates with features>. Texts without digits, @ or (at) cost a scan each."""

    def with_pieces(s: Column) -> Column:
        starts = _starts(s.pieces, s.hits)
        runs = F.transform(F.arrays_zip(starts.alias("at"), s.hits.alias("hit")), lambda r, i: F.struct(r["at"].alias("at"), r["hit"].alias("hit"), F.right(F.get(s.pieces, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(s.pieces, i + 1), F.lit(1)).alias("after")))
        return let(F.transform(runs, _run_found), lambda f: F.struct(F.flatten(F.transform(f, lambda x: x["base"])).alias("base"), F.flatten(F.transform(f, lambda x: x["more"])).alias("more")))

    nothing = F.struct(F.array().cast(NONE).alias("base"), F.array().cast(CANDIDATE).alias("more")).cast(FOUND)
    split = F.struct(F.split(text, RUN, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("hits"))
    numbers = F.when(F.rlike(text, F.lit(MAY_RUN)), let(split, with_pieces)).otherwise(nothing)
    emails = F.when(F.contains(text, F.lit("@")), F.transform(located(text, BASE[EMAIL]), lambda h: coded(h["at"], EMAIL, F.length(h["hit"])))).otherwise(F.array().cast(NONE))
    at = F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]"))
    spelled = F.when(at, _generated(text, F.lit(0), F.lit(""), F.lit(""), [(EMAIL, SPELLED)])).otherwise(F.array().cast(CANDIDATE))
    return let(numbers, lambda n: F.struct(F.concat(emails, n["base"]).alias("base"), F.concat(spelled, n["more"]).alias("more")))


# ---- trees


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree as nested tuples (feature, limit, below, else), or a leaf's value; exact greedy splits."""
    best = (1e-6, None, None)
    if depth and len(x) >= 10:
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            for limit in np.unique(x[:, f])[1:]:
                low = x[:, f] < limit
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - whole
                if gain > best[0] + 1e-9:
                    best = (gain, f, int(limit))
    if best[1] is None:
        return float(RATE * g.sum() / (h.sum() + 1))
    low = x[:, best[1]] < best[2]
    return (best[1], best[2], _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, limit, a, b = tree
    return np.where(x[:, f] < limit, _value(a, x), _value(b, x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list:
    """Gradient boosting of the logistic loss."""
    score, out = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        out.append(_grow(x, y - p, p * (1 - p), depth))
        score += _value(out[-1], x)
    return out


def tree_column(tree, features: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, limit, a, b = tree
    return F.when(F.get(features, F.lit(f)) < limit, tree_column(a, features)).otherwise(tree_column(b, features))


def calibrated(score: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The least score from which on held-out examples are right at the wanted precision; infinite if there is none."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
    last = np.concatenate((np.diff(score[order]) != 0, [True])) if len(order) else np.zeros(0, bool)
    good = np.flatnonzero((right >= precision) & last & (np.cumsum(y[order]) >= 5))
    return float(score[order][good[-1]]) if len(good) else float("inf")


# ---- labelled examples


def _card(rng: random.Random, ok: bool) -> str:
    while True:
        d = str(rng.choice((4, 5, 3, 6))) + "".join(rng.choice("0123456789") for _ in range(15))
        total = sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(d))))
        if (total % 10 == 0) == ok:
            sep = rng.choice(("", "", " ", "-"))
            return sep.join(d[i : i + 4] for i in range(0, 16, 4))


def examples(n: int = EXAMPLES, seed: int = 23) -> list[tuple[str, set[tuple[int, int, int]]]]:
    """Texts and the spans (kind, start, end) in them that are personal data."""
    rng = random.Random(seed)
    words = "the of and her number was sent to our office in May we saw it near old town when he came back from work Straße café número".split()
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    local = lambda: rng.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "({}){}-{}")).format(number(3), number(3), number(4))
    world = lambda: f"+{rng.choice(('1', '44', '49', '33'))} ({number(3)}) {number(3)}-{number(4)}"
    said = {PHONE: ("phone", "call", "tel:", "mobile", "fax", ""), CARD: ("card", "visa", "credit card", "paid with", "", ""), EMAIL: ("mail", "contact", "write to", "", "")}
    out = []
    for _ in range(n):
        text, spans = " ".join(rng.choices(words, k=rng.randint(1, 6))), set()

        def put(s: str, kind: int | None, glue: str = " ") -> None:
            nonlocal text
            text += glue
            if kind is not None:
                spans.add((kind, len(text), len(text) + len(s)))
            text += s

        case = rng.randint(0, 11)
        if case <= 1:  # a number that runs into a card, or a card into a number
            order = [(world(), PHONE), (_card(rng, True), CARD)]
            for s, kind in order if rng.random() < 0.7 else order[::-1]:
                put(s, kind)
        elif case == 2:
            for _ in range(rng.randint(2, 3)):
                put(_card(rng, True), CARD)
        elif case <= 4:
            word = rng.choice(said[PHONE])
            put(word, None) if word else None
            put(local(), PHONE)
        elif case == 5:
            word = rng.choice(said[EMAIL])
            put(word, None) if word else None
            put(f"{rng.choice(words).lower()}{rng.choice(('', '.' + number(2), number(1)))}{rng.choice((' (at) ', '(at)', ' [at] ', '[at]'))}mail{rng.choice((' (dot) ', '.', '(dot)', ' [dot] '))}{rng.choice(('com', 'org', 'example'))}", EMAIL)
        elif case <= 7:  # failing check digits
            for _ in range(rng.randint(1, 3)):
                put(_card(rng, False), None)
        elif case == 8:
            put(rng.choice(("order", "invoice", "ref", "serial", "ISBN", "part", "version", "ticket", "sku")), None)
            put(rng.choice((f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)} {number(3)} {number(4)}", f"{number(3)}.{number(3)}.{number(4)}")), None)
        elif case == 9:
            put(rng.choice((number(20), number(22), number(31), f"{number(4)} {number(4)} {number(4)} {number(2)}", f"{number(2)}.{number(2)}.{number(4)}", f"{number(4)}-{number(2)}-{number(2)} {number(2)}")), None)
        elif case == 10:
            put(rng.choice(("met (at) noon. then", "look (at) this.and", "sat [at] home.then", "rate (at) 5.20 percent", "seen (at) ten.We")), None)
        else:
            put(world(), PHONE)
            put(_card(rng, False), None)
        out.append((text + rng.choice((" ", ", ", ". ", "; ")) + " ".join(rng.choices(words, k=rng.randint(1, 5))), spans))
    return out


_trained: dict[str, tuple[list, dict[int, float]]] = {}


def model(spark: SparkSession) -> tuple[list, dict[int, float]]:
    """Trees, and the threshold of each kind."""
    key = spark.sparkContext.applicationId
    if key not in _trained:
        labelled = examples()
        df = spark.range(1).select(F.posexplode(F.split(F.lit("\x1e".join(t for t, _ in labelled)), "\x1e")).alias("i", "text"))
        rows = df.select("i", F.explode(candidates(F.col("text"))["more"]).alias("c")).select("i", span_kind(F.col("c.code")).alias("kind"), span_start(F.col("c.code")).alias("start"), span_length(F.col("c.code")).alias("n"), "c.features").collect()
        x = np.array([r.features for r in rows])
        y = np.array([(r.kind, r.start, r.start + r.n) in labelled[r.i][1] for r in rows], float)
        half = np.array([r.i % 2 == 0 for r in rows])
        trees = boost(x[half], y[half])
        score = sum(_value(t, x) for t in trees)
        _trained[key] = trees, {k: calibrated(score[~half & (x[:, 0] == k)], y[~half & (x[:, 0] == k)]) for k in (EMAIL, CARD, PHONE)}
    return _trained[key]


def spans(docs: DataFrame, trained=None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, text (null: empty), base and spans: sorted coded spans."""
    trees, limits = trained or model(docs.sparkSession)

    def chosen(c: Column) -> Column:
        score = reduce(lambda a, b: a + b, [tree_column(t, c["features"]) for t in trees], F.lit(0.0))
        kind = F.get(c["features"], F.lit(0))
        limit = F.lit(float("inf"))
        for k, v in limits.items():
            limit = F.when(kind == k, F.lit(v)).otherwise(limit)
        return score >= limit

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(*keep, text.alias("text")).withColumn("found", F.explode(F.array(candidates(F.col("text")))))
    more = F.transform(F.filter("found.more", chosen), lambda c: c["code"])
    return found.select(*keep, "text", F.sort_array("found.base").alias("base"), F.sort_array(F.array_distinct(F.concat("found.base", more))).alias("spans"))


def listed(codes: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda c: F.element_at(F.array(*map(F.lit, KINDS)), span_kind(c) + 1)
    return F.array_join(F.transform(codes, lambda c: F.concat_ws(":", name(c), span_start(c).cast("string"), (span_start(c) + span_length(c)).cast("string"))), ",")


def _equals(k: int):
    return lambda c: c == k


def digest(found: DataFrame) -> DataFrame:
    kinds = F.transform("base", span_kind)
    counts = [F.size(F.filter(kinds, _equals(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(text: Column, codes: Column) -> Column:
    """The text with each span, or stretch of overlapping spans, replaced by its first kind in brackets."""
    ends = lambda c: span_start(c) + span_length(c)
    item = "array<struct<a:int,b:int,k:int>>"

    def fold(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], ends(c)).alias("b"), last["k"].alias("k"))))
        apart = F.concat(acc, F.array(F.struct(span_start(c).alias("a"), ends(c).alias("b"), span_kind(c).alias("k"))))
        return F.when(last.isNotNull() & (span_start(c) < last["b"]), joined).otherwise(apart).cast(item)

    def rebuilt(m: Column) -> Column:
        tag = lambda k: F.element_at(F.array(*(F.lit(f"[{n.upper()}]") for n in KINDS)), k + 1)
        from_ = lambda i: F.coalesce(F.get(m, i - 1)["b"], F.lit(0))
        parts = F.transform(m, lambda x, i: F.concat(F.substring(text, from_(i) + 1, x["a"] - from_(i)), tag(x["k"])))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(m, -1)["b"] + 1, F.length(text)))

    return F.when(F.size(codes) == 0, text).otherwise(let(F.aggregate(codes, F.array().cast(item), fold), rebuilt))
