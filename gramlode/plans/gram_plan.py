"""What grams a matching document must hold: a boolean plan over 3-byte grams, derived from the pattern's fixed texts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gramlode.functions.grams import fnv1a, gram_bytes, gram_key
from gramlode.plans import regex as rx

#: Most grams whose presence fits the bits of one long.
MASK_BITS = 63


@dataclass(frozen=True)
class Lookup:
    gram: int


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class FullScan:
    pass


Plan = Lookup | And | Or | FullScan


def _of_text(text: str, ignore_case: bool) -> Plan:
    """Every gram of the ASCII-lowered bytes; with ignore_case, not across characters that fold in other ways."""
    pieces = [text]
    if ignore_case:
        pieces = "".join(c if c.isascii() else "\0" for c in text).split("\0")
    grams: dict[int, None] = {}
    for piece in pieces:
        raw = piece.encode().lower()
        grams |= {gram_key(raw[i : i + 3]): None for i in range(len(raw) - 2)}
    if not grams:
        return FullScan()
    found = tuple(map(Lookup, grams))
    return found[0] if len(found) == 1 else And(found)


def _of(node: rx.Node, ignore_case: bool) -> Plan:
    match node:
        case rx.Literal(text):
            return _of_text(text, ignore_case)
        case rx.Capture(child):
            return _of(child, ignore_case)
        case rx.Concat(items):
            return And(tuple(_of(x, ignore_case) for x in items))
        case rx.Alternation(items):
            return Or(tuple(_of(x, ignore_case) for x in items))
    return FullScan()


def simplified(plan: Plan) -> Plan:
    """FullScan is neutral in And and absorbing in Or; a single part stands for itself. Nested Ands stay nested."""
    if not isinstance(plan, And | Or):
        return plan
    parts = [simplified(p) for p in plan.parts]
    if isinstance(plan, Or):
        if FullScan() in parts:
            return FullScan()
    else:
        parts = [p for p in parts if p != FullScan()]
        if not parts:
            return FullScan()
    return parts[0] if len(parts) == 1 else type(plan)(tuple(parts))


def plan_of(pattern: str, ignore_case: bool = False) -> Plan:
    return simplified(_of(rx.parse(pattern)[0], ignore_case))


def grams_of(plan: Plan) -> list[int]:
    """Distinct grams, first seen first."""
    if isinstance(plan, Lookup):
        return [plan.gram]
    return list(dict.fromkeys(g for p in getattr(plan, "parts", ()) for g in grams_of(p)))


def explain(plan: Plan, depth: int = 0) -> str:
    pad = "  " * depth
    if isinstance(plan, FullScan):
        return pad + "FULL_SCAN"
    if isinstance(plan, Lookup):
        raw = gram_bytes(plan.gram)
        return f'{pad}lookup "{raw.decode(errors="replace")}" → 0x{fnv1a(raw):016x}'
    name = "AND" if isinstance(plan, And) else "OR"
    return "\n".join([f"{pad}{name}(", *(explain(p, depth + 1) for p in plan.parts), f"{pad})"])


def presence(plan: Plan) -> Column:
    """Aggregate over a document's postings: which of the plan's grams it holds, as bits or, for many, as a set."""
    grams = grams_of(plan)
    if len(grams) <= MASK_BITS:
        case = reduce(lambda c, ig: c.when(F.col("gram") == ig[1], F.lit(1 << ig[0]).cast("long")), enumerate(grams), F)
        return F.bit_or(case)
    return F.collect_set("gram")


def holds(plan: Plan, have: Column) -> Column:
    """The plan as a condition on presence()."""
    grams = grams_of(plan)
    bit = {g: 1 << i for i, g in enumerate(grams)}

    def walk(p: Plan) -> Column:
        if isinstance(p, Lookup):
            return have.bitwiseAND(F.lit(bit[p.gram]).cast("long")) != 0 if len(grams) <= MASK_BITS else F.array_contains(have, p.gram)
        if not p.parts:
            return F.lit(False)
        return reduce(lambda a, b: a & b if isinstance(p, And) else a | b, map(walk, p.parts))

    return F.lit(True) if isinstance(plan, FullScan) else walk(plan)
