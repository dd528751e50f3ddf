import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import names, paths, scalars, snippets
from tracewell.operators import graphs, incremental, report, triage
from tracewell.sources import ignore

PATHS = [
    ("src/a.test.ts", "test"), ("tests/a.ts", "test"), ("app/__mocks__/x.ts", "test"), ("src/Mock/a.ts", "test"), ("e2e/login.ts", "test"),
    ("dist/a.js", "generated"), ("src/api.pb.ts", "generated"), ("types/index.d.ts", "generated"), ("db/migrations/1.ts", "generated"),
    ("src/app.ts", "production"), ("src/contest/a.ts", "production"), ("src\\tests\\a.ts", "test"),
]


def test_path_categories(spark):
    df = spark.createDataFrame(PATHS, "path string, want string")
    assert df.filter(paths.category(F.col("path")) != F.col("want")).collect() == []


def test_artifacts(spark):
    df = spark.createDataFrame([("public/assets/a.js", True), ("src/index-XQYQww37.js", True), ("src/index.js", False), ("a/main.a1b2c3d4.mjs", True)], "path string, want boolean")
    assert df.filter(paths.is_artifact(F.col("path")) != F.col("want")).collect() == []


def test_entropy(spark):
    words = ["", "aaaa", "abab", "abcd", "é漢漢é"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", scalars.entropy(F.col("w"))).collect()}
    assert got == {"": 0.0, "aaaa": 0.0, "abab": 1.0, "abcd": 2.0, "é漢漢é": 1.0}


def test_half_rounds_up(spark):
    got = spark.range(1).select(scalars.half_up(F.lit(2.5)), scalars.half_up(F.lit(-0.5)), scalars.half_up(F.lit(2.4))).first()
    assert tuple(got) == (3, 0, 2)


def test_lattice_laws(spark):
    every = spark.range(5).select(F.col("id").cast("int").alias("a")).crossJoin(spark.range(5).select(F.col("id").cast("int").alias("b")))
    a, b = F.col("a"), F.col("b")
    bad = every.filter((scalars.lattice_join(a, b) != scalars.lattice_join(b, a)) | (scalars.lattice_meet(a, b) != scalars.lattice_meet(b, a)) | ~scalars.lattice_leq(a, scalars.lattice_join(a, b)))
    assert bad.count() == 0
    assert every.filter((a == 1) & (b == 2)).select(scalars.lattice_join(a, b)).first()[0] == 4


@pytest.mark.parametrize(
    ("rule", "path", "want"),
    [
        ("*.log", "a/b.log", True), ("*.log", "b.log", True), ("/b.log", "a/b.log", False), ("build/", "a/build/x", True), ("build/", "build", False),
        ("**/x", "x", False), ("**/x", "a/x", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[ab].ts", "b.ts", True), ("docs/*.md", "docs/a/b.md", False),
    ],
)
def test_ignore_globs(spark, rule, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(ignore.ignored(F.col("p"), ignore.parse([rule]))).first()[0] is want


def test_last_rule_wins(spark):
    rules = ignore.parse(["# all", "*.ts", "", "!keep.ts"])
    df = spark.createDataFrame([("a.ts",), ("keep.ts",), ("a.js",)], "path string")
    assert [r[0] for r in ignore.kept(df, rules).orderBy("path").collect()] == ["a.js", "keep.ts"]


def test_package_names(spark):
    df = spark.createDataFrame([("lodash/fp", "lodash"), ("@a/b/c", "@a/b"), ("node:fs", "node:fs"), ("react", "react")], "s string, want string")
    assert df.filter(names.package_of(F.col("s")) != F.col("want")).collect() == []


def test_nearest_name_prefers_the_first(spark):
    got = spark.createDataFrame([("axois",)], "n string").select(names.nearest(F.col("n"), ("react", "axios", "axios2"))).first()[0]
    assert (got.nearest, got.distance) == ("axios", 2)


def test_snippet_and_suppression(spark):
    text = "a\n// tracewell-disable-next-line\nb\nc // tracewell-ignore-line\nd"
    df = spark.createDataFrame([(text, k) for k in range(1, 6)], "t string, k int")
    assert [r[0] for r in df.orderBy("k").select(snippets.suppressed(F.col("t"), F.col("k"))).collect()] == [False, False, True, True, False]
    assert df.filter("k = 1").select(snippets.context_snippet(F.col("t"), F.col("k"), 1)).first()[0].split("\n")[0] == ">    1 | a"


def _issue(**own):
    base = {"ord": 1, "engine": "idor", "severity": "error", "confidence": None, "file_path": "src/a.ts", "line": 1, "message": "m", "entropy": None, "context_snippet": ""}
    return tuple((base | own).values())


SCHEMA = "ord long, engine string, severity string, confidence string, file_path string, line int, message string, entropy double, context_snippet string"


def test_triage_order_and_values(spark):
    rows = [
        _issue(ord=1),  # 40 * 2 * 1.5 = 120 -> 100
        _issue(ord=2, engine="empty-catch", severity="warning", confidence="medium"),  # 24
        _issue(ord=3, file_path="tests/a.ts", engine="missing-await"),  # test: warning, 20 * 2 * .3 = 12
        _issue(ord=4, file_path="dist/a.ts"),  # generated: gone
        _issue(ord=5, engine="missing-await", message="catalog entry"),  # a substring, not a word
        _issue(ord=6, confidence="low"),  # low access issues go
    ]
    got = {r["ord"]: (r["severity"], r["risk_score"], r["priority"]) for r in triage.triaged(triage.located(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {1: ("error", 100, "critical"), 2: ("warning", 24, "medium"), 3: ("warning", 12, "low")}


def test_triage_of_nothing(spark):
    assert triage.triaged(triage.located(spark.createDataFrame([], SCHEMA))).count() == 0
    assert report.dedup_stats(report.deduplicated(spark.createDataFrame([], SCHEMA), F.lit("x"))).first()["reduction_percent"] == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=12))
def test_closure_is_reachability(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    start = spark.createDataFrame([(0, 0)], "start long, node long")
    seen, todo = {0}, [0]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    assert {r["node"] for r in graphs.reachable(df, start, "a", "b").collect()} == seen


def test_snapshots(spark):
    before = incremental.snapshot(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, content string"))
    now = incremental.snapshot(spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "")], "path string, content string"))
    assert {r["path"]: r["state"] for r in incremental.compared(now, before).collect()} == {"a": "cached", "b": "stale", "c": "deleted", "d": "stale"}


def test_common_root(spark):
    df = spark.createDataFrame([("/srv/app/x/a.ts",), ("/srv/app/y/b.ts",)], "file_path string")
    assert report.common_root(df).first()["root"] == "/srv"


def test_entropy_agrees_with_definition(spark):
    text = "hello world"
    want = -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))
    assert abs(spark.range(1).select(scalars.entropy(F.lit(text))).first()[0] - want) < 1e-12


def test_a_closure_of_bits_is_that_of_rounds(spark):
    """Gaps, negative ids, nulls, cycles, nodes outside the graph, starts at several nodes; more starts than a word has bits."""
    import random

    from tracewell.operators import graphs

    r = random.Random(4)
    ids = [r.randrange(-1000, 1000) for _ in range(150)]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(170)] + [(None, 1), (2, None)]
    starts = [(k, r.choice(ids)) for k in range(200) for _ in range(1 + k % 2)] + [(7, None), (500, None), (501, 10**12), (None, ids[0])]
    edges = spark.createDataFrame(pairs, "a long, b long")
    start = spark.createDataFrame(starts, "start int, node long")
    after = {}
    for a, b in pairs:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)
    want = set()
    for k, node in starts:
        seen, todo = {node}, [node]
        while todo:
            for to in after.get(todo.pop(), ()):
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        want |= {(k, x) for x in seen}
    got = [tuple(x) for x in graphs.reachable(edges, start, "a", "b").collect()]
    assert set(got) == want and len(got) == len(want)
    counted = {x["start"]: (x["reached"], x["least"], x["greatest"]) for x in graphs.reached(edges, start, "a", "b").collect()}
    of = lambda k: [x for s, x in want if s == k]
    some = lambda k: [x for x in of(k) if x is not None]
    assert counted == {k: (len(of(k)), min(some(k), default=None), max(some(k), default=None)) for k, _ in want}
    named = lambda df: df.selectExpr(*[f"cast({c} AS string) AS {c}" if c != "start" else c for c in df.columns])
    assert {tuple(x) for x in graphs.reachable(named(edges), named(start).filter("start < 100 AND node IS NOT NULL"), "a", "b").collect()} == {(k, str(x)) for k, x in want if k is not None and k < 100 and x is not None}


def test_a_closure_sends_starts_alone(spark):
    """The pairs of a closure are not shuffled: only the starts are dealt out."""
    from tracewell.plans import catalog

    for name in ("q41_reverse_closure", "q61_reverse_closure_all"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1, plan
