"""Patterns, plans and small functions; no Spark."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gramlode.functions.grams import distinct_grams, fnv1a, gram_key
from gramlode.functions.text import format_size, parse_size
from gramlode.plans import gram_plan as gp
from gramlode.plans.regex import PatternError, parse, to_java


def look(*grams):
    return [gp.Lookup(gram_key(g.encode())) for g in grams]


@pytest.mark.parametrize("pattern,plan", [
    ("hello", gp.And(tuple(look("hel", "ell", "llo")))), ("foo", look("foo")[0]), ("foo.*bar", gp.And(tuple(look("foo", "bar")))),
    ("foo|bar", gp.Or(tuple(look("foo", "bar")))), ("(foo)(bar)", gp.And(tuple(look("foo", "bar")))),
    ("(foo|bar)baz", gp.And((gp.Or(tuple(look("foo", "bar"))), look("baz")[0]))), ("[abc]def", look("def")[0]), ("[a]bc", look("abc")[0]),
    (".*", gp.FullScan()), ("", gp.FullScan()), ("[a-z]", gp.FullScan()), ("fn", gp.FullScan()), ("ab.cd", gp.FullScan()),
    ("foo|[a-z]", gp.FullScan()), ("a|b", gp.FullScan()), ("(foo)+", gp.FullScan()), ("(?i)abc", gp.FullScan()), ("fn.*parse", gp.And(tuple(look("par", "ars", "rse")))),
    ("aaaa", look("aaa")[0]), ("FOO", look("foo")[0]), (r"a\.b", look("a.b")[0]), (r"x{3}abc", look("abc")[0]), (r"(?:foo)bar", gp.And(tuple(look("foo", "oob", "oba", "bar")))), ("^foo$", look("foo")[0]), (r"\x66oo", look("foo")[0]),
])
def test_plans(pattern, plan):
    assert gp.plan_of(pattern) == plan


def test_ignore_case_plans():
    assert gp.plan_of("Hello", True) == gp.plan_of("hello")
    assert gp.plan_of("École abc", True) == gp.And(tuple(look("col", "ole", "le ", "e a", " ab", "abc")))
    assert gp.plan_of("éàü", True) == gp.FullScan()


def test_explain():
    assert gp.explain(gp.plan_of("abc")) == 'lookup "abc" → 0xe71fa2190541574b'
    assert gp.explain(gp.plan_of("(abc|[a-z]def)xyz")).split("\n")[0:3] == ["AND(", "  OR(", '    lookup "abc" → 0xe71fa2190541574b']
    assert gp.explain(gp.plan_of("x")) == "FULL_SCAN"


@pytest.mark.parametrize("bad", ["(", ")", "[a", "a**", "*a", "a++", "(?=a)", "(?!a)", "(?<=a)", "(?<!a)", r"\1", "(?>a)", "a{2,1}", r"\q", "[b-a]", r"\p{nope}", "[[:nope:]]", "x{", "(?P<1a>x)", "(?x)a", "\\"])
def test_rejected(bad):
    with pytest.raises(PatternError):
        parse(bad)


def test_java():
    assert to_java("a b") == r"(?dU)a\x{20}b"
    assert to_java("[[:alpha:]_]x", True) == "(?dUiu)[A-Za-z_]x"
    assert to_java("(?P<word>a)") == "(?dU)(?<g1word>a)"
    assert to_java(r"[\w&&x]") == r"(?dU)[\w&&x]"


def test_hash_and_sizes():
    assert [f"{fnv1a(x):016x}" for x in (b"abc", b"def", b"fn ", b"")] == ["e71fa2190541574b", "ca9a1a18f461e4cc", "dcb5d018fedca5ef", "cbf29ce484222325"]
    assert [parse_size(x) for x in ("10M", "500k", "1G", "7")] == [10 << 20, 500 << 10, 1 << 30, 7]
    assert [format_size(x) for x in (1023, 1024, 5 << 30)] == ["1023B", "1.0KB", "5120.0MB"]
    with pytest.raises(ValueError):
        parse_size("10MB")


def test_grams():
    assert distinct_grams(b"ab").tolist() == [] and distinct_grams(b"ABCabc").tolist() == sorted(map(gram_key, (b"abc", b"bca", b"cab")))
    assert set(map(gram_key, (b"akb", b"kbc"))) <= set(distinct_grams("a\u212abc".encode()).tolist())


LITERALS = st.text("abcxyzABCéÉkK \u212a\u017fs", min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(LITERALS, min_size=1, max_size=3), st.text("abcxyzABCéÉkK \u212a\u017fs", max_size=40), st.booleans())
def test_pruning_never_drops_a_match(words, text, ignore_case):
    """The plan holds for every text that the pattern matches."""
    for pattern in (".*".join(map(re.escape, words)), "|".join(map(re.escape, words)), f"({re.escape(words[0])}|[a-c]x)" + re.escape(words[-1])):
        if re.search(pattern, text, re.IGNORECASE if ignore_case else 0):
            grams = set(distinct_grams(text.encode()).tolist())

            def holds(p):
                match p:
                    case gp.Lookup(g):
                        return g in grams
                    case gp.And(parts):
                        return all(map(holds, parts))
                    case gp.Or(parts):
                        return any(map(holds, parts))
                return True

            assert holds(gp.plan_of(pattern.replace("\\ ", " "), ignore_case))
