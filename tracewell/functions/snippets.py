"""Lines of source text around a place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def context_snippet(content: Column, line: Column, around: int = 2) -> Column:
    """The line (from 1) and those around it, numbered, the line itself marked."""
    lines = F.split(content, "\n", -1)
    first = F.greatest(F.lit(1), line - around)
    near = F.slice(lines, first, F.greatest(F.lit(0), line + around - first + 1))  # so that the text is split once, not for each line
    shown = F.transform(near, lambda text, k: F.concat(F.when(first + k == line, "> ").otherwise("  "), F.lpad((first + k).cast("string"), 4, " "), F.lit(" | "), text))
    return F.array_join(shown, "\n")


def suppressed(content: Column, line: Column, tool: str = "tracewell") -> Column:
    """Whether a comment on the line, or on the one before for the next, switches its findings off."""
    lines = F.split(content, "\n", -1)
    at = lambda i: F.coalesce(F.try_element_at(lines, F.greatest(i, F.lit(1))), F.lit(""))
    return at(line).rlike(f"{tool}-(disable|ignore)-line") | ((line > 1) & at(line - 1).rlike(f"{tool}-(disable|ignore)-next-line"))


def with_previous(content: Column) -> Column:
    """array of (line, previous): every line of a text with the one before it, null for the first; the text is split once."""
    lines = F.split(content, "\n", -1)
    return F.arrays_zip(lines.alias("line"), F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, F.lit(1), F.size(lines) - 1)).alias("previous"))
