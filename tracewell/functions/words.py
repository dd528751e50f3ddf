"""Identifiers, wildcards and short texts for reports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def identifier_words(name: Column) -> Column:
    """The lower-case words of an identifier, cut at capitals, `_`, `-` and `.`."""
    parted = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(parted), r"[_.\-]+"), lambda w: F.length(w) > 0)


def has_keyword(name: Column, word: str) -> Column:
    """Whether a word stands in an identifier between its boundaries: in lower case, as a part in camel case, or in capitals."""
    low, cap, up = re.escape(word.lower()), re.escape(word[:1].upper() + word[1:].lower()), re.escape(word.upper())
    return name.rlike(rf"(?:^|[^A-Za-z]){low}(?:[^a-z]|$)") | name.rlike(rf"{cap}(?:[^a-z]|$)") | name.rlike(rf"(?:^|[^A-Z]){up}(?:[^A-Z]|$)")


def operational(name: Column, qualifiers: Sequence[str]) -> Column:
    """Whether all words of an identifier behind the first are qualifiers (tokenCount, password_length): a measure, no secret."""
    words = identifier_words(name)
    return (F.size(words) > 1) & F.forall(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda w: w.isin(*qualifiers))


def glob_regex(pattern: str) -> str:
    """A wildcard pattern as a regular expression: `*` is any text, `?` one character."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)


def fits_glob(text: Column, pattern: str) -> Column:
    """Whether the whole text fits a wildcard pattern, whatever the case."""
    return F.lower(text).rlike(f"^(?:{glob_regex(pattern.lower())})$")


def truncated(path: Column, width: int = 60) -> Column:
    """A path of at most so many characters: the last segments that fit behind "...", or the end of the last one."""
    parts = F.split(path, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    fitting = F.filter(tails, lambda t: F.length(t) <= width - 4)
    shown = F.when(F.size(fitting) > 0, F.concat(F.lit(".../"), F.element_at(fitting, 1))).otherwise(F.concat(F.lit("..."), F.right(path, F.lit(width - 3))))
    return F.when(F.length(path) <= width, path).otherwise(shown)


def elapsed(millis: Column) -> Column:
    """350ms, 1.2s or 2m 3s."""
    seconds = F.floor(millis / 1000)
    short = F.concat(F.format_number(millis / 1000.0, 1), F.lit("s"))
    long = F.concat((F.floor(seconds / 60)).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))
    return F.when(millis < 1000, F.concat(millis.cast("long").cast("string"), F.lit("ms"))).when(millis < 60_000, short).otherwise(long)
