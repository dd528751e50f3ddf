import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.taint import access, facts, flows

INPUT = "struct<kind:string,param:int,label:string,path:array<string>>"


def tables(spark, functions, sources=(), hits=(), calls=(), args=(), transfers=()):
    make = spark.createDataFrame
    return flows.Summaries(
        make(functions, "fn string, file_path string, is_sanitizer boolean, sanitizer_kind string"),
        make(list(sources), "fn string, kind string, label string, path array<string>"),
        make(list(hits), f"fn string, hit_ix int, input {INPUT}, sink_kind string, sink_callee string, sanitized boolean, sanitizations array<string>, line int"),
        make(list(calls), "caller string, edge_ix int, callee string, line int, assigned_to string"),
        make(list(args), f"caller string, edge_ix int, input {INPUT}, callee_param int"),
        make(list(transfers), "fn string, param int, to_kind string, sanitized boolean, sanitizations array<string>, confidence string"),
    )


def param(k):
    return ("param", k, f"p{k}", [])


def value(label, *path):
    return ("value", None, label, list(path))


@pytest.fixture
def chain(spark):
    """A reads a request and calls B, which calls C, which queries; D cleans; E returns its parameter."""
    return tables(
        spark,
        [("A", "a.ts", False, None), ("B", "b.ts", False, None), ("C", "b.ts", False, None), ("D", "d.ts", True, "escape"), ("E", "e.ts", False, None)],
        [("A", "req.body", "body", [])],
        [("C", 0, param(0), "sql-query", "db.query", False, [], 30), ("D", 0, param(0), "sql-query", "db.query", False, [], 40), ("A", 0, value("out"), "html-output", "res.send", False, [], 9), ("A", 1, value("body", "name"), "eval", "eval", False, [], 10)],
        [("A", 0, "B", 5, None), ("B", 0, "C", 15, None), ("A", 1, "D", 6, None), ("A", 2, "E", 7, "out"), ("C", 0, "A", 33, None)],
        [("A", 0, value("body", "id"), 0), ("B", 0, param(0), 0), ("A", 1, value("body"), 0), ("A", 2, value("body"), 0), ("C", 0, param(0), 0)],
        [("E", 0, "return", False, [], "likely")],
    )


def test_forward_flows(chain):
    got = {(r["sink_fn"], r["line"]): r for r in flows.forward(chain).collect()}
    assert set(got) == {("C", 30), ("A", 10), ("A", 9)}  # what E hands back comes to the caller that gave it
    assert [(t["fn"], t["how"], t["line"]) for t in got["A", 9]["trace"]] == [("A", "source", None), ("E", "through", 7)] and got["A", 9]["confidence"] == "likely"
    assert [t["fn"] for t in got["C", 30]["trace"]] == ["A", "B", "C"] and got["C", 30]["hops"] == 1 and got["C", 30]["files"] == 2
    every = {(r["sink_fn"], r["line"]): (r["sanitized"], r["confidence"]) for r in flows.forward(chain, include_sanitized=True).collect()}
    assert every[("D", 40)] == (True, "definite")


def test_a_walk_does_not_come_back(spark):
    """What a helper reads and returns comes to its caller."""
    s = tables(
        spark,
        [("A", "a.ts", False, None), ("E", "e.ts", False, None), ("B", "b.ts", False, None)],
        [("E", "env", "return", [])],
        [("B", 0, value("x"), "eval", "eval", False, [], 3)],
        [("B", 0, "E", 2, "x")],
    )
    got = flows.forward(s).collect()
    assert [(r["source_fn"], r["sink_fn"], [t["how"] for t in r["trace"]]) for r in got] == [("E", "B", ["source", "return"])]


def test_options(chain):
    assert flows.forward(chain, sink_kinds=["eval"]).count() == 1
    assert flows.forward(chain, source_kinds=["cookie"]).count() == 0
    assert {r["sink_fn"] for r in flows.forward(chain, depth=1).collect()} == {"A"}
    assert {r["line"] for r in flows.cross_file(flows.forward(chain)).collect()} == {9, 30}  # to C, and through E


def test_backward_flows(chain):
    got = flows.backward(chain, "C").collect()
    assert [(r["source_fn"], r["sink_fn"], r["line"]) for r in got] == [("A", "C", 30)]
    assert flows.backward(chain, "E").count() == 0


def test_a_value_returns_to_the_caller_that_gave_it(spark):
    """Both A and B call E, which hands its parameter back; only A gives it a request. D reads one and returns it over G."""
    s = tables(
        spark,
        [(f, f"{f}.ts", f == "H", "escape" if f == "H" else None) for f in "ABDEGH"],
        [("A", "req.body", "body", []), ("D", "req.query", "return", [])],
        [(f, k, value(x), "eval", "eval", False, [], 10 + k) for f, k, x in (("A", 0, "x"), ("B", 1, "x"), ("B", 2, "y"), ("A", 3, "z"))],
        [("A", 0, "E", 1, "x"), ("B", 0, "E", 2, "x"), ("B", 1, "G", 3, "y"), ("G", 0, "D", 4, "return"), ("A", 1, "H", 5, "z")],
        [("A", 0, value("body"), 0), ("B", 0, value("fixed"), 0), ("A", 1, value("body"), 0)],
        [("E", 0, "return", False, [], "definite"), ("H", 0, "return", False, ["numeric-cast"], "possible")],
    )
    found = {(r["source_fn"], r["sink_fn"], r["line"]): r for r in flows.forward(s, include_sanitized=True).collect()}
    assert set(found) == {("A", "A", 10), ("D", "B", 12), ("A", "A", 13)}
    assert [(t["fn"], t["how"]) for t in found["D", "B", 12]["trace"]] == [("D", "source"), ("G", "return"), ("B", "return")]
    cleaned = found["A", "A", 13]
    assert (cleaned["sanitized"], cleaned["sanitizations"], cleaned["confidence"]) == (True, ["escape", "numeric-cast"], "possible")
    assert {(r["source_fn"], r["line"]) for r in flows.forward(s).collect()} == {("A", 10), ("D", 12)}
    assert flows.forward(s, include_sanitized=True, least="likely").count() == 2


def test_states_are_few_where_walks_are_many(spark):
    """Ten diamonds in a row have 1,024 ways of 20 calls; a recursion swaps its parameters."""
    calls = [x for k in range(10) for x in ((f"a{k}", 0, f"l{k}"), (f"a{k}", 1, f"r{k}"), (f"l{k}", 0, f"a{k + 1}"), (f"r{k}", 0, f"a{k + 1}"))]
    s = tables(
        spark,
        [(f, f"{f}.ts", False, None) for f in sorted({x for c in calls for x in (c[0], c[2])} | {"swap", "aside"})],
        [("a0", "req.body", "body", []), ("swap", "env", "env", []), ("aside", "env", "env", [])],
        [("a10", 0, param(0), "eval", "eval", False, [], 7), ("swap", 0, param(0), "eval", "eval", False, [], 8)],
        [(a, k, b, 1, None) for a, k, b in calls] + [("swap", 2, "swap", 2, None), ("swap", 3, "swap", 3, None), ("a10", 5, "aside", 9, None)],
        [(a, k, value("body") if a == "a0" else param(0), 0) for a, k, b in calls] + [("swap", 2, param(1), 0), ("swap", 3, value("env"), 1), ("a10", 5, param(0), 0)],
    )
    met = flows.states(s, s.hits.filter("fn = 'a10'"), 20)
    assert met.count() == 31 and met.filter("fn IN ('swap', 'aside')").count() == 0
    got = {r["source_fn"]: (r["depth"], [t["fn"] for t in r["trace"]]) for r in flows.forward(s, depth=20).collect()}
    assert got["a0"] == (20, [x for k in range(10) for x in (f"a{k}", f"l{k}")] + ["a10"])
    assert got["swap"] == (2, ["swap", "swap", "swap"]) and "aside" not in got
    assert {r["source_fn"] for r in flows.forward(s).collect()} == {"swap"}  # ten calls at most
    assert flows.forward(s, source_kinds=["nothing"]).count() == 0 and flows.backward(s, "aside").count() == 0


def test_summary_and_sinks(chain):
    found = flows.forward(chain, include_sanitized=True)
    told = {(r["by"], r["value"]): r["flows"] for r in flows.summary(found).collect()}
    assert told[("all", None)] == 4 and told[("sink", "sql-query")] == 2 and told[("source", "req.body")] == 4
    assert flows.rendered(found).first()[0].startswith("[CRITICAL]")
    shown = [json.loads(r[0]) for r in flows.sarif_flows(found).collect()]
    longest = max(shown, key=lambda r: len(r["codeFlows"][0]["threadFlows"][0]["locations"]))
    assert [x["nestingLevel"] for x in longest["codeFlows"][0]["threadFlows"][0]["locations"]] == [0, 0, 1]


def test_placeholders_are_rewired(spark, chain):
    cut_off = flows.Summaries(chain.functions, chain.sources, chain.hits, chain.calls.withColumn("callee", F.when(F.col("callee") == "C", "b.ts#C").otherwise(F.col("callee"))), chain.args, chain.transfers)
    assert flows.forward(cut_off, sink_kinds=["sql-query"]).count() == 0
    linked = cut_off.rewired(spark.createDataFrame([("b.ts#C", "C")], "placeholder string, target string"))
    assert flows.forward(linked, sink_kinds=["sql-query"]).count() == 1


def test_access_paths(spark):
    df = spark.createDataFrame([("a.b[0].c",), ("a",), ("a.*",)], "t string").select("t", access.parse(F.col("t")).alias("p"))
    got = {r["t"]: (r["x"], r["up"], r["more"]) for r in df.select("t", access.text(F.col("p")).alias("x"), access.text(access.parent(F.col("p"))).alias("up"), access.text(access.append(F.col("p"), F.lit("z"))).alias("more")).collect()}
    assert got["a.b[0].c"] == ("a.b.0.c", "a.b.0", "a.b.0.c.z") and got["a"][1] is None
    pair = spark.createDataFrame([("a.*", "a.b", True), ("a.*", "a.b.c", False), ("a.*", "a", False), ("a.b", "a.b", True)], "x string, y string, want boolean")
    assert pair.filter(access.matches(access.parse(F.col("x")), access.parse(F.col("y"))) != F.col("want")).count() == 0
    lead = spark.createDataFrame([("a.b.c", "a.b", True), ("a.b", "a.b.c", False), ("ab.c", "a", False)], "x string, y string, want boolean")
    assert lead.filter(access.starts_with(access.parse(F.col("x")), access.parse(F.col("y"))) != F.col("want")).count() == 0


FACT = st.tuples(st.integers(0, 4), st.sets(st.sampled_from("ab")), st.sets(st.sampled_from("xy")))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(FACT, FACT), min_size=1, max_size=20))
def test_facts_join_alike_both_ways(spark, pairs):
    rows = [tuple((s, sorted(a), sorted(b)) for s, a, b in pair) for pair in pairs]
    df = spark.createDataFrame(rows, f"a {facts.SCHEMA}, b {facts.SCHEMA}")
    a, b = F.col("a"), F.col("b")
    assert df.filter(facts.join(a, b) != facts.join(b, a)).count() == 0
    assert df.filter(facts.join(a, a)["state"] != a["state"]).count() == 0
    assert df.filter(facts.is_tainted(a) & ~facts.is_tainted(facts.join(a, b))).filter("b.state <> 3").count() == 0


def test_states_and_heaps_meet(spark):
    left = spark.createDataFrame([("x", (2, ["q"], [])), ("y", (3, ["q"], ["e"]))], f"v string, fact {facts.SCHEMA}")
    right = spark.createDataFrame([("x", (1, [], [])), ("z", (2, ["r"], []))], f"v string, fact {facts.SCHEMA}")
    got = {r["v"]: (r["fact"]["state"], r["fact"]["sanitizers"]) for r in facts.join_states(left, right, ["v"]).collect()}
    assert got == {"x": (4, []), "y": (3, ["e"]), "z": (2, [])}
    heap = "path string, sources array<string>, sanitized boolean, kinds array<string>"
    one = spark.createDataFrame([("p", ["a"], True, ["e", "n"]), ("q", ["a"], True, ["e"])], heap)
    two = spark.createDataFrame([("p", ["b"], True, ["e"])], heap)
    assert {r["path"]: tuple(r)[1:] for r in facts.join_heaps(one, two).collect()} == {"p": (["a", "b"], True, ["e"]), "q": (["a"], False, [])}
