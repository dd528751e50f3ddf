"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Features, rules and scores are Column expressions throughout; the trees are fitted on the driver to a bounded sample of
labelled URLs (per_class of each label, weighted back to all) and scored as nested CASE expressions. The block rates of host
suffixes are counted over all labelled URLs and joined as a table. Labels are given, or come from the rules:
URLs that a rule judges teach the trees, which never see host or path by name, only lexical shape and the block rate of
host suffixes.

Defined results: a URL that is null or has no "://" has an empty host and path, fits no rule and is judged by the trees;
without labelled URLs every other URL is allowed. Of rules of equal length the first wins. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import tables

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digits", "host_digits", "hyphens", "parameters", "entropy", "vowels", "has_fragment", "suffix_rate")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (the first given of equal length), and its verdict; null without one. A rule fits its host
    and all subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("double")


def lexical(url: Column, host: Column, path: Column, suffix_rate: Column) -> dict[str, Column]:
    whole = F.coalesce(url, F.lit(""))
    n = F.length(whole)
    share = lambda c: (n - F.length(F.replace(whole, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(whole, "")), F.lit(0.0), lambda a, c: F.when(F.length(c) == 0, a).otherwise(a - share(c) * F.log2(share(c))))
    columns = (
        n.cast("double"), F.length(host).cast("double"), F.length(path).cast("double"), _count(path, "/"), _count(host, ".") + 1,
        _count(whole, "0123456789") / F.greatest(n, F.lit(1)), _count(host, "0123456789"), _count(host, "-"), _count(whole, "=&"),
        F.when(n > 0, entropy).otherwise(F.lit(0.0)), _count(host, "aeiou") / F.greatest(F.length(host), F.lit(1)), _count(whole, "#"), suffix_rate,
    )
    return dict(zip(FEATURES, columns, strict=True))


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


@dataclass
class Trees:
    """Boosted regression trees: each is nested (feature, threshold, left, right) or a leaf's value. suffixes: (__suffix, __known)."""

    base: float = -2.0
    trees: list = field(default_factory=list)
    suffixes: DataFrame | None = None
    prior: float = 0.5

    def column(self, features: dict[str, Column]) -> Column:
        def node(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            name, cut, left, right = tree
            return F.when(features[name] <= F.lit(float(cut)), node(left)).otherwise(node(right))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + node(tree)
        return 1 / (1 + F.exp(-total))

    def rated(self, rows: DataFrame, host: str = "host") -> DataFrame:
        """rows with __suffix_rate: the smoothed share of blocked URLs of a host's last label."""
        if self.suffixes is None:
            return rows.withColumn("__suffix_rate", F.lit(self.prior))
        met = rows.withColumn("__suffix", suffix_of(F.col(host))).join(self.suffixes, "__suffix", "left")
        return met.withColumn("__suffix_rate", F.coalesce("__known", F.lit(self.prior))).drop("__suffix", "__known")


def boost(x: np.ndarray, y: np.ndarray, names: Sequence[str], rounds: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 10, ridge: float = 1.0, weight: np.ndarray | None = None) -> tuple[float, list]:
    """Newton boosting of the logistic loss on binned features; rows count by their weight."""
    w = np.ones(len(y)) if weight is None else weight
    p0 = min(max(np.average(y, weights=w), 1e-3), 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)])
    score, trees = np.full(len(y), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for k in range(x.shape[1]) if left else ():
            n = len(cuts[k]) + 1
            sums = [np.cumsum(np.bincount(code[rows, k], v, n))[:-1] for v in (g[rows], h[rows], np.ones(len(rows)))]
            if not len(sums[0]):
                continue
            gl, hl, cl = sums
            gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
            gain[(cl < least) | (len(rows) - cl < least)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, at)
        if best[1] is None:
            value = float(-rate * total_g / (total_h + ridge))
            score[rows] += value
            return value
        _, k, at = best
        under = code[rows, k] <= at
        return (names[k], float(cuts[k][at]), grow(rows[under], g, h, left - 1), grow(rows[~under], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), w * (p - y), w * p * (1 - p), depth))
    return base, trees


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", id_col: str = "page_id", per_class: int = 4000) -> Trees:
    """Fits to about per_class URLs of each label (allow or block), weighted by their label's share of all; only their features reach the driver."""
    url = F.col(url_col)
    labelled = labelled.filter(F.col(label_col).isin("allow", "block") & F.col(id_col).isNotNull())
    blocked = (F.col(label_col) == "block").cast("int")
    counts = tables.cut(labelled.groupBy(suffix_of(host_of(url)).alias("__suffix")).agg(F.count("*").alias("n"), F.sum(blocked).alias("blocked")))
    every = counts.agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).first()
    if not every["n"]:
        return Trees()
    prior = every["blocked"] / every["n"]
    smooth = lambda blocked, n: (blocked + F.lit(20 * prior)) / (n + 20)
    known = tables.if_small(counts.select("__suffix", smooth(F.col("blocked"), F.col("n")).alias("__known")))
    model = Trees(suffixes=known, prior=prior)
    sample = tables.class_sample(labelled, label_col, id_col, per_class, salt=23)
    shown = sample.select(F.col(id_col).alias("id"), url.alias("url"), blocked.alias("y"), host_of(url).alias("host"), path_of(url).alias("path"))
    # a training URL's suffix rate is counted without itself, so that its own label is not among its features
    apart = smooth(F.col("blocked") - F.col("y"), F.col("n") - 1)
    shown = shown.withColumn("__suffix", suffix_of(F.col("host"))).join(tables.if_small(counts), "__suffix").withColumn("__suffix_rate", apart)
    columns = lexical(F.col("url"), F.col("host"), F.col("path"), F.col("__suffix_rate"))
    got = shown.select("id", "y", "host", *[c.alias(n) for n, c in columns.items()]).collect()
    if not got:
        return model
    got.sort(key=lambda r: (str(r["id"]), r["host"]))
    y = np.array([r["y"] for r in got], float)
    x = np.array([[r[f] for f in FEATURES] for r in got], float)
    taken = y.sum(), len(y) - y.sum()
    share = np.where(y == 1, every["blocked"] / max(1, taken[0]), (every["n"] - every["blocked"]) / max(1, taken[1]))
    model.base, model.trees = boost(x, y, FEATURES, weight=share / share.mean())
    return model


def judge(pages: DataFrame, model: Trees, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", block_from: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict and score (the trees' chance of block), whatever other columns they have."""
    taken = {"host", "path", "rule", "verdict", "score"}
    shown = pages.select(*[c for c in pages.columns if c.lower() not in taken or c == url_col], host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    features = lexical(F.col(url_col), F.col("host"), F.col("path"), F.col("__suffix_rate"))
    named = model.rated(shown).withColumns({f"__{n}": c for n, c in features.items()})
    scored = named.withColumn("score", model.column({n: F.col(f"__{n}") for n in features})).drop(*[f"__{n}" for n in features])
    return scored.withColumns({"rule": rule, "verdict": F.coalesce(says, F.when(F.col("score") >= block_from, "block").otherwise("allow"))})


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = tables.read(spark, sf_dir, "pages").select("page_id", "url")
    model = train(pages.withColumn("label", rule_of(host_of(F.col("url")), path_of(F.col("url")))[1]))
    return judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")
