import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gramlode.llm import pii, registry
from gramlode.llm.common import table

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def listed(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def random_texts(n, seed):
    rng = random.Random(seed)
    bits = ["a@b.c", "@", "x.y%z@q-r.com", "1.2.3.4", "256.1.1.1", "00012.3.4.255", "4111 1111 1111 1111", "4111111111111111", "4111111111111112", "+1 (425) 555-9684", "+", "(", ")", "-", " ", ".", "é", "𝔘", "12", "7", "\n", "%", "word", "340000000000009", "+49 30 1234567", "555-123-4567", "bob (at) mail (dot) com", "  "]
    return ["".join(rng.choice(bits) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return [None, "", "1" * 5000, "1.1" * 2000, "a." * 3000 + "@" + "b." * 3000, "+1" * 3000, " " * 5000, "5 " * 4000 + "x", ("4111 1111 1111 1111; " * 700)] + random_texts(500, 1)


@pytest.fixture(scope="module")
def found(spark, texts):
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(0, None, 4)], "doc_id long, text string, spans int").repartition(4)
    return pii.digest(pii.spans(df)).collect()


def test_base_spans_equal_plain_patterns(found, texts):
    assert len(found) == len(texts) + 1
    for r in found:
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[1] == k for b in base) for k in range(4)]
        every = r.spans.split(",") if r.spans else []
        assert set(listed(base).split(",")) - {""} <= set(every) and len(every) == len(set(every))


def test_added_spans(spark):
    good = "call +1 (425) 555-9684 4111111111111111 now", "bob.12 (at) mail (dot) com", "phone 555-123-4567 ok"
    clean = "number 4111111111111112 here", "invoice 555-123-4567", "we met (at) noon. fine", "+1 (425) 555-9684 4111111111111112", "text without any", "The licence 2.0 and 3.1.4"
    df = spark.createDataFrame(list(enumerate(good + clean)), "doc_id int, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.spans(df)).collect()}
    assert got[0] == "phone:5:22,card:23:39"
    assert got[1] == "email:0:26" and got[2] == "phone:6:18"
    assert got[3] == got[4] == got[5] == got[7] == got[8] == ""
    assert got[6] == "phone:0:17"


def test_redaction(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    s = pii.spans(df)
    for r in s.select("doc_id", "text", "spans", pii.redacted(F.col("text"), F.col("spans")).alias("out"), pii.listed(F.col("spans")).alias("listed")).collect():
        want, at = "", 0
        merged = []
        for item in filter(None, r.listed.split(",")):
            kind, a, b = item.split(":")
            if merged and int(a) < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], int(b))
            else:
                merged.append([int(a), int(b), kind])
        for a, b, kind in merged:
            want, at = want + r.text[at:a] + f"[{kind.upper()}]", b
        assert r.out == want + r.text[at:]


def test_main_path_is_native(spark):
    plan = registry.op2_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)
    assert pii.spans(table(spark, "/root/testdata/sf0.001", "documents").filter("false")).count() == 0
