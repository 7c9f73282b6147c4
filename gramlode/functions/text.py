"""Column expressions on text, and sizes in words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RED, MAGENTA, GREEN, CYAN, RESET = "\x1b[1;31m", "\x1b[1;35m", "\x1b[32m", "\x1b[36m", "\x1b[0m"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def lines(text: Column) -> Column:
    """Lines without their ends: one carriage return is stripped, nothing follows a final newline, an empty text has none."""
    parts = F.split(text, "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    # only texts that hold a carriage return pay for looking at every line
    return F.when(F.contains(text, F.lit("\r")), F.transform(kept, lambda x: F.regexp_replace(x, "\r\\z", ""))).otherwise(kept)


def highlighted(line: Column, java_pattern: str) -> Column:
    return F.regexp_replace(line, F.lit(f"({java_pattern})"), F.lit(RED + "$0" + RESET))


def format_size(n: int) -> str:
    if n < 1024:
        return f"{n}B"
    return f"{n / 1024:.1f}KB" if n < 1024 * 1024 else f"{n / 1024 / 1024:.1f}MB"


def format_size_column(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / F.lit(1024.0)), F.lit("KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / F.lit(1048576.0)), F.lit("MB")))
    )


def parse_size(text: str) -> int:
    """10M, 500K, 1G or a plain number of bytes; the unit's case is free."""
    found = re.fullmatch(r"\s*(\d+)([KMG]?)\s*", text.upper())
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(found[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[found[2]]
