"""Access paths as Column expressions: struct(root, fields), with "*" for any one field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(root: Column, fields: Column) -> Column:
    return F.struct(root.alias("root"), F.coalesce(fields, F.array().cast("array<string>")).alias("fields"))


def parse(text: Column) -> Column:
    """a.b[0].c to (a, [b, 0, c]); [*] is the wildcard."""
    parts = F.split(F.regexp_replace(text, r"\[([^\]]*)\]", r".$1"), r"\.")
    return make(F.element_at(parts, 1), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))


def text(path: Column) -> Column:
    return F.array_join(F.concat(F.array(path["root"]), path["fields"]), ".")


def starts_with(path: Column, prefix: Column) -> Column:
    """Whether prefix leads to path: the same root, and its fields are the first of path's."""
    n = F.size(prefix["fields"])
    return (path["root"] == prefix["root"]) & (F.size(path["fields"]) >= n) & (F.slice(path["fields"], F.lit(1), n) == prefix["fields"])


def parent(path: Column) -> Column:
    """Null for a root."""
    n = F.size(path["fields"])
    return F.when(n > 0, make(path["root"], F.slice(path["fields"], F.lit(1), F.greatest(n - 1, F.lit(0)))))


def append(path: Column, field: Column) -> Column:
    return make(path["root"], F.concat(path["fields"], F.array(field)))


def matches(pattern: Column, path: Column) -> Column:
    """Equality, where a wildcard at the end of the pattern stands for exactly one more field."""
    n = F.size(pattern["fields"])
    wild = (n > 0) & (F.try_element_at(pattern["fields"], F.lit(-1)) == "*")
    head = F.slice(pattern["fields"], F.lit(1), F.greatest(n - 1, F.lit(0)))
    one_more = (F.size(path["fields"]) == n) & (F.slice(path["fields"], F.lit(1), F.greatest(n - 1, F.lit(0))) == head)
    return (pattern["root"] == path["root"]) & F.when(wild, one_more).otherwise(pattern["fields"] == path["fields"])


def overlap(a: Column, b: Column) -> Column:
    """Whether one leads to the other, either way."""
    return starts_with(a, b) | starts_with(b, a)
