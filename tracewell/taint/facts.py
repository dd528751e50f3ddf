"""Taint facts: a lattice state with its sources and sanitizers, joined and met column by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import scalars

BOTTOM, UNTAINTED, TAINTED, SANITIZED, TOP = range(5)
SCHEMA = "struct<state:int,sources:array<string>,sanitizers:array<string>>"


def make(state: int, sources: list[str] = (), sanitizers: list[str] = ()) -> Column:
    words = lambda xs: F.array(*[F.lit(x) for x in sorted(set(xs))]).cast("array<string>")
    return F.struct(F.lit(state).alias("state"), words(sources).alias("sources"), words(sanitizers).alias("sanitizers"))


def is_tainted(fact: Column) -> Column:
    """Tainted, or top: what may be tainted counts."""
    return fact["state"].isin(TAINTED, TOP)


def join(a: Column, b: Column) -> Column:
    """Where paths meet: sources unite; a sanitizer stays only if both sides have it, or if the other side has no fact."""
    both = F.array_sort(F.array_intersect(a["sanitizers"], b["sanitizers"]))
    one = a["state"].isin(BOTTOM) != b["state"].isin(BOTTOM)
    kept = F.when(one & (a["state"] == BOTTOM), b["sanitizers"]).when(one, a["sanitizers"]).otherwise(both)
    return F.struct(scalars.lattice_join(a["state"], b["state"]).alias("state"), F.array_sort(F.array_union(a["sources"], b["sources"])).alias("sources"), kept.alias("sanitizers"))


def meet(a: Column, b: Column) -> Column:
    return F.struct(scalars.lattice_meet(a["state"], b["state"]).alias("state"), F.array_sort(F.array_intersect(a["sources"], b["sources"])).alias("sources"), F.array_sort(F.array_union(a["sanitizers"], b["sanitizers"])).alias("sanitizers"))


def join_states(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Two abstract states (key columns, fact) at a merge of control flow: a variable that only one side knows keeps its fact."""
    met = left.join(right.withColumnRenamed("fact", "__other"), key, "full_outer")
    none = make(BOTTOM)
    return met.select(*key, join(F.coalesce("fact", none), F.coalesce("__other", none)).alias("fact"))


def join_heaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two heaps (path, sources, sanitized, kinds): sources unite; a path is sanitized only if both sides sanitized it, by the
    kinds they share; a path that one side alone knows loses its sanitization."""
    r = right.select("path", F.col("sources").alias("r_sources"), F.col("sanitized").alias("r_sanitized"), F.col("kinds").alias("r_kinds"))
    empty = F.array().cast("array<string>")
    both = F.coalesce("sanitized", F.lit(False)) & F.coalesce("r_sanitized", F.lit(False))
    sources = F.array_sort(F.array_union(F.coalesce("sources", empty), F.coalesce("r_sources", empty)))
    return left.join(r, "path", "full_outer").select("path", sources.alias("sources"), both.alias("sanitized"), F.when(both, F.array_sort(F.array_intersect("kinds", "r_kinds"))).otherwise(empty).alias("kinds"))
