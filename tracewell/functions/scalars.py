"""Scalar functions over findings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks and weights that decide results.
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
PRIORITY = {"low": 0, "medium": 1, "high": 2, "critical": 3}
DISPLAY_RANK = {
    "idor": 10, "missing-input-validation": 9, "hardcoded-secret": 8, "stack-trace-exposure": 7, "missing-await": 6,
    "async-foreach": 5, "hallucinated-deps": 4, "unsafe-regex": 3, "console-in-production": 2, "empty-catch": 1,
}
DANGER_RANK = {
    "idor": 1, "missing-input-validation": 2, "hardcoded-secret": 3, "stack-trace-exposure": 4, "missing-await": 5,
    "async-foreach": 6, "hallucinated-deps": 7, "unsafe-regex": 8, "console-in-production": 9, "empty-catch": 10,
}
SECURITY = ("hardcoded-secret", "idor", "missing-input-validation", "stack-trace-exposure", "unsafe-regex")


def lookup(value: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for key, number in table.items():
        out = F.when(value == key, F.lit(number)).otherwise(out)
    return out


def confidence(c: Column) -> Column:
    """Missing confidence counts as high."""
    return F.coalesce(c, F.lit("high"))


def half_up(x: Column) -> Column:
    """Rounds a half towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("int")


def display_risk(severity: Column, conf: Column, engine: Column) -> Column:
    base = F.when(severity == "error", 100).when(severity == "warning", 50).otherwise(10)
    times = F.when(confidence(conf) == "high", 3).when(confidence(conf) == "medium", 2).otherwise(1)
    return base * times + lookup(engine, DISPLAY_RANK, 0)


def entropy(s: Column) -> Column:
    """Bits a character; 0 for an empty string."""
    n = F.length(s)
    share = lambda c: F.size(F.filter(F.split(s, ""), lambda d: d == c)) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))


def lattice_join(a: Column, b: Column) -> Column:
    """Of 0 bottom, 1 untainted, 2 tainted, 3 sanitized, 4 top."""
    return F.when(a == b, a).when(a == 0, b).when(b == 0, a).otherwise(F.lit(4))


def lattice_meet(a: Column, b: Column) -> Column:
    return F.when(a == b, a).when(a == 4, b).when(b == 4, a).otherwise(F.lit(0))


def lattice_leq(a: Column, b: Column) -> Column:
    return (a == b) | (a == 0) | (b == 4)


def exact_key(engine: Column, message: Column, snippet: Column) -> Column:
    tidy = F.trim(F.regexp_replace(F.coalesce(snippet, F.lit("")), r"\s+", " "))
    return F.substring(F.sha2(F.concat_ws(":", engine, message, tidy), 256), 1, 16)


def message_key(engine: Column, message: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", engine, message), 256), 1, 16)


def baseline_key(path: Column, line: Column, engine: Column, message: Column) -> Column:
    return F.sha2(F.concat_ws(":", path, line.cast("string"), engine, F.substring(message, 1, 100)), 256)
