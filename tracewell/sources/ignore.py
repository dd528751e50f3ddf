"""Ignore rules: parsing of rule files, and the last matching rule as a Column expression."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_regex(pattern: str) -> str:
    """A rule's glob as a regular expression over relative paths with forward slashes.

    `*` stays within a segment, `**` crosses segments (`**/x` wants at least one directory before x), `?` is one character
    and brackets are classes. A leading slash anchors the rule at the root; a rule without any slash fits a segment anywhere.
    """
    folder = pattern.endswith("/")
    body = pattern.rstrip("/")
    rooted = body.startswith("/")
    body = body.lstrip("/")
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out.append(".*/")
            i += 3
        elif body.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            inner = body[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
            i = end + 1
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
            i += 1
    start = "^" if rooted else "(^|/)"
    return start + "".join(out) + ("/" if folder else "(/|$)")


def parse(lines: Iterable[str]) -> list[tuple[str, bool]]:
    """(regular expression, negated) of each rule, in order; blank lines and comments are skipped."""
    rules = []
    for line in (x.strip() for x in lines):
        if line and not line.startswith("#"):
            rules.append((to_regex(line[1:] if line.startswith("!") else line), line.startswith("!")))
    return rules


def load(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """The rules of a file in any store that Spark reads. Its readers skip names with a leading dot, so this asks the store itself."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return parse(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines())
    finally:
        stream.close()


def ignored(path: Column, rules: Sequence[tuple[str, bool]]) -> Column:
    """Whether the last rule that fits ignores the path; a path that none fits is kept."""
    out = F.lit(False)
    for pattern, negated in rules:
        out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def kept(files: DataFrame, rules: Sequence[tuple[str, bool]], path_col: str = "path") -> DataFrame:
    return files.filter(~ignored(F.col(path_col), rules))
