"""Control flow, definitions and taint of own snippets; dominators against a walk in Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.extract import bindings, cfg, facts
from tracewell.taint import dataflow, flows, resolve, summaries

CODE = """function f(a, b) {
  let x = a;
  if (a > 0) { x = b; } else if (b) return 1;
  for (const i of xs) { if (i) continue; if (b) break; x += i; }
  try { go(x); throw new E(); } catch (e) { x = 0; } finally { done(); }
  switch (a) { case 1: x = 1; case 2: x = 2; break; default: x = 3 }
  outer: while (true) { do { if (a) break outer; } while (b); }
  a && go(b);
  const y = a ? b : x;
  return x;
}
const g = (z) => z && z.q;
"""


def test_edges_of_every_construct():
    rows = cfg.read_graphs(CODE)
    labels = {r["label"] for r in rows if r["kind"] == "edge"}
    assert labels == {"next", "true", "false", "back", "case", "default", "exception", "break", "continue", "return", "throw"}
    blocks = {(r["fn"], r["block"]) for r in rows if r["kind"] == "block"}
    assert all((r["fn"], r["block"]) in blocks and (r["fn"], r["to"]) in blocks for r in rows if r["kind"] == "edge")
    assert {r["var"] for r in rows if r["kind"] == "def" and not r["var"].startswith("@")} == {"x", "y", "a", "b", "z"}


@pytest.mark.parametrize("text", ["", "function", "if (", "x = {", "try {", "switch(", "for(;;)", "do", "a:", "function f(){ if (", "function f(){ switch(a){ case", "function f(){ try {} catch", "() => {", "function f(a=b){ return a ? }", "}}}", "((("])
def test_any_text_has_a_graph(text):
    cfg.read_graphs(text)
    bindings.read_flows(text)


def test_dominators_agree_with_paths(spark):
    r = random.Random(3)
    for _ in range(3):
        n = 14
        pairs = sorted({(k, r.randrange(n)) for k in range(n) for _ in range(2)})
        steps = spark.createDataFrame([("p", "f", a, b, "next") for a, b in pairs], "path string, fn string, block int, to int, label string")
        first = spark.createDataFrame([("p", "f", 0)], "path string, fn string, block int")

        def seen(without, pairs=pairs):
            found, todo = {0} - {without}, [0] if without != 0 else []
            while todo:
                u = todo.pop()
                for a, b in pairs:
                    if a == u and b != without and b not in found:
                        found.add(b)
                        todo.append(b)
            return found

        live = seen(None)
        want = {(b, d) for b in live for d in live if d == b or b not in seen(d)}
        blocks = dataflow.structure(steps, first).cache()
        assert {(x["block"], x["dominator"]) for x in dataflow.dominators(blocks).collect()} == want
        back = {(x["block"], x["to"]) for x in dataflow.back_edges(steps, blocks).collect()}
        assert back == {(a, b) for a, b in pairs if a in live and (a, b) in want}
        strict = {b: {d for x, d in want if x == b and d != b} for b in live}
        rows = blocks.collect()
        assert {x["block"]: x["idom"] for x in rows} == {b: max(ds, key=lambda d: len(strict[d])) if ds else None for b, ds in strict.items()}
        assert {(x["block"], y["block"]) for x in rows for y in rows if y["enter"] <= x["enter"] and x["leave"] <= y["leave"]} == want
        assert {(x["block"], b) for x in rows for b in x["frontier"]} == {(d, b) for p, b in pairs if p in live for d in live if (p, d) in want and (d == b or (b, d) not in want)}
        assert sorted(x["rank"] for x in rows) == list(range(len(live)))


def test_order_of_blocks(spark):
    """In a reducible graph every block comes after all that lead to it, but for back edges."""
    pairs = [(0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (5, 5), (5, 6)]
    steps = spark.createDataFrame([("p", f, a, b) for f in "fg" for a, b in pairs], "path string, fn string, block int, to int")
    first = spark.createDataFrame([("p", "f", 0), ("p", "g", 4), ("p", "alone", 9)], "path string, fn string, block int")
    blocks = dataflow.structure(steps, first).cache()
    rank = {(x["fn"], x["block"]): x["rank"] for x in blocks.collect()}
    back = {(x["fn"], x["block"], x["to"]) for x in dataflow.back_edges(steps, blocks).collect()}
    assert back == {("f", 4, 1), ("f", 5, 5), ("g", 2, 4), ("g", 3, 4), ("g", 5, 5)}
    assert all(rank[f, a] < rank[f, b] for f in "fg" for a, b in pairs if (f, a, b) not in back and (f, a) in rank)
    assert rank["alone", 9] == 0 and ("g", 0) not in rank


def test_a_deep_function_is_numbered_in_one_pass(spark):
    steps = spark.range(5000).selectExpr("'p' AS path", "'f' AS fn", "id AS block", "id + 1 AS to")
    first = spark.createDataFrame([("p", "f", 0)], "path string, fn string, block int")
    assert dataflow.structure(steps, first).agg(F.max("depth")).first()[0] == 5000


SNIPPETS = {
    "plain": ("function f(req) { const q = req.query.q; db.query(q); }", [("db-query", "req-query", False)]),
    "direct": ("function f(req) { db.query(`a ${req.body.x}`); }", [("db-query", "req-body", False)]),
    "overwritten": ("function f(req) { let q = req.query.q; q = 'a'; db.query(q); }", []),
    "one_branch": ("function f(req, c) { let q = req.query.q; if (c) { q = 'a'; } db.query(q); }", [("db-query", "req-query", False)]),
    "cast": ("function f(req) { const n = parseInt(req.params.n, 10); db.query(n); }", [("db-query", "req-params", True)]),
    "typed": ("function f(req) { const q = req.query.q; if (typeof q === 'number') { db.query(q); } }", []),
    "not_typed": ("function f(req) { const q = req.query.q; if (typeof q !== 'number') { db.query(q); } }", [("db-query", "req-query", False)]),
    "early": ("function f(req) { const q = req.query.q; if (!allowed.has(q)) { return; } db.query(q); }", []),
    "literal": ("function f(req) { const q = req.query.q; if (q === 'asc') { db.query(q); } }", []),
    "either": ("function f(req, c) { const q = req.query.q; if (c || allowed.has(q)) { db.query(q); } }", [("db-query", "req-query", False)]),
    "both": ("function f(req, c) { const q = req.query.q; if (c && allowed.has(q)) { db.query(q); } }", []),
    "mixed": ("function f(req, a, b) { const q = req.query.q; if (!validate(q) && a || b) { return; } db.query(q); }", [("db-query", "req-query", False)]),
    "bracketed": ("function f(req, a, b) { const q = req.query.q; if ((a || b) && allowed.has(q)) { db.query(q); } }", []),
    "neither": ("function f(req, a) { const q = req.query.q; if (!(a && allowed.has(q))) { return; } db.query(q); }", []),
    "each_way": ("function f(req, a) { const q = req.query.q; if (a && q === 'x' || allowed.has(q)) { db.query(q); } }", []),
    "chosen": ("function f(req, a) { const q = req.query.q; if (a ? allowed.has(q) : true) { db.query(q); } }", [("db-query", "req-query", False)]),
    "loop": ("function f(req) { let q = ''; for (const i of xs) { db.query(q); q = req.body.v; } }", [("db-query", "req-body", False)]),
    "catch": ("function f(req) { let q = 'a'; try { q = req.body.v; go(); } catch (e) { eval(q); } }", [("eval", "req-body", False)]),
    "self": ("function f(req) { let q = req.body.v; q = escapeHtml(q); res.send(q); }", [("html-output", "req-body", True)]),
    "chain": ("function f(req) { const q = req.body.v.trim().toLowerCase(); exec(q); }", [("command-exec", "req-body", False)]),
    "none": ("function f(req) { const q = 'x'; db.query(q); }", []),
}


@pytest.fixture(scope="module")
def inside(spark):
    files = spark.createDataFrame([(k, code) for k, (code, _) in SNIPPETS.items()], "path string, content string")
    out = {}
    for r in dataflow.tainted(cfg.extract(files)).collect():
        out.setdefault(r["path"], set()).add((r["sink_kind"], r["origin"], r["sanitized"]))
    return out


@pytest.mark.parametrize("name", SNIPPETS)
def test_taint_inside_a_function(inside, name):
    assert inside.get(name, set()) == set(SNIPPETS[name][1])


PROJECT = {
    "src/h.ts": "import { run, clean as wash } from './lib';\nimport * as util from './util';\nexport function handle(req, res) {\n  const id = req.body.id;\n  run(id);\n  const out = util.pass(req.query.q);\n  res.send(out);\n  res.send(wash(req.params.p));\n}\n",
    "src/lib.ts": "export { run } from './db';\nexport function clean(x) { return escapeHtml(x); }\n",
    "src/db.ts": "export function run(sql) {\n  return db.query('select ' + sql);\n}\n",
    "src/util.ts": "export * from './deep';\n",
    "src/deep.ts": "export function pass(v) { const w = v; return inner(w); }\nfunction inner(z) { return z; }\nexport default function (q) { return q; }\n",
}


@pytest.fixture(scope="module")
def project(spark):
    files = spark.createDataFrame(list(PROJECT.items()), "path string, content string")
    read, bound = facts.extract(files).cache(), bindings.extract(files).cache()
    links = resolve.links(bound, read, files).cache()
    return files, read, links, summaries.build(bound, links)


def test_calls_are_resolved_through_imports_and_reexports(project):
    assert {(r["path"], r["callee_fn"]) for r in project[2].collect()} == {("src/deep.ts", "src/deep.ts#inner"), ("src/h.ts", "src/db.ts#run"), ("src/h.ts", "src/lib.ts#clean"), ("src/h.ts", "src/deep.ts#pass")}


def test_summaries_from_code(project):
    s = project[3]
    moved = {(r["fn"], r["param"]): (r["sanitized"], r["sanitizations"]) for r in s.transfers.collect()}
    assert moved == {("src/deep.ts#inner", 0): (False, []), ("src/deep.ts#pass", 0): (False, []), ("src/deep.ts#@3:16", 0): (False, []), ("src/db.ts#run", 0): (False, []), ("src/lib.ts#clean", 0): (True, ["html-escape"])}
    assert {r["fn"]: r["sanitizer_kind"] for r in s.functions.filter("is_sanitizer").collect()} == {"src/lib.ts#clean": "html-escape"}
    found = {(r["source_kind"], r["sink_fn"], r["sink_kind"], r["sanitized"]) for r in flows.forward(s, include_sanitized=True).collect()}
    assert found == {("req-body", "src/db.ts#run", "db-query", False), ("req-query", "src/h.ts#handle", "html-output", False), ("req-params", "src/h.ts#handle", "html-output", True)}
    up = {(r["fn"], r["sink_kind"]) for r in summaries.carried_hits(s).filter("input.label = 'req-body'").collect()}
    assert up == {("src/h.ts#handle", "db-query")}


def test_a_source_is_returned_over_files(spark):
    code = {
        "src/read.ts": "export function q(req) { const v = req.query.q; return v; }\nexport function clean(req) { return escapeHtml(req.query.q); }\n",
        "src/mid.ts": "import { q } from './read';\nexport function over(req) { const t = q(req); return t; }\nexport function other() { return over2(); }\n",
        "src/use.ts": "import { over } from './mid';\nimport { clean } from './read';\nexport function h(r) { const x = over(r); db.query(x); }\nexport function g(r) { db.query(clean(r)); }\nexport function f(r) { over(r); db.query('fixed'); }\n",
    }
    files = spark.createDataFrame(list(code.items()), "path string, content string")
    read, bound = facts.extract(files).cache(), bindings.extract(files).cache()
    found = flows.forward(summaries.build(bound, resolve.links(bound, read, files))).collect()
    assert [(r["source_fn"], r["source_kind"], r["sink_fn"], [(t["fn"], t["how"]) for t in r["trace"]]) for r in found] == [
        ("src/read.ts#q", "req-query", "src/use.ts#h", [("src/read.ts#q", "source"), ("src/mid.ts#over", "return"), ("src/use.ts#h", "return")])
    ]


def test_names_of_imports(spark):
    rows = [("a.ts", "import d, { x as y, type T } from './m';\nimport * as ns from './n';\nconst r = require('./o');\nimport './side';\n")]
    read = facts.extract(spark.createDataFrame(rows, "path string, content string"))
    got = {(r["name"], r["local"], r["imported"]) for r in resolve.imported_names(read).collect()}
    assert got == {("./m", "d", "default"), ("./m", "y", "x"), ("./m", "T", "T"), ("./n", "ns", "*"), ("./o", "r", "*")}


def test_reaching_definitions_in_a_loop(spark):
    read = cfg.extract(spark.createDataFrame([("a", "function f(c) { let x = 1; while (c) { use(x); x = 2; } return x; }")], "path string, content string")).cache()
    defs = dataflow.definitions(read)
    reach = dataflow.reaching(defs, dataflow.edges(read))
    test = read.filter("kind = 'block' AND label = 'test'").select("block")
    assert reach.join(test, "block").filter("var = 'x'").select("def").distinct().count() == 2
    assert reach.filter(F.col("var") == "c").select("def").distinct().count() == 1


def test_names_that_count_inside_one_function(spark):
    code = {
        "orm": "function f(req) { const id = req.params.id; return Model.findById(id); }", "checked": "function f(req) { const b = validateBody(req.body); store.save(b); }",
        "schema": "function f(req) { const b = schema.parse(req.body); store.insert(b); }", "file": "function f(req) { fsp.readFile(req.query.path); }", "away": "function f(ctx) { ctx.redirect(ctx.query.to); }", "other": "function f(req) { list.push(req.body); }",
    }
    files = spark.createDataFrame(list(code.items()), "path string, content string")
    got = {(r["path"], r["sink_kind"], r["origin"], tuple(r["sanitizations"])) for r in dataflow.tainted(cfg.extract(files), summaries.SCOPE).collect()}
    assert got == {("orm", "db-query", "req.params", ()), ("checked", "db-mutation", "req.body", ("validator",)), ("schema", "db-mutation", "req.body", ("schema",)), ("file", "file-read", "req.query", ()), ("away", "redirect", "ctx.query", ())}


def test_a_long_chain_of_reexports_and_a_cycle(spark):
    chain = [(f"src/m{k}.ts", f"export * from './m{k + 1}';\n") for k in range(40)] + [("src/m40.ts", "export function deep(x) { return x; }\nexport * from './m0';\n")]
    files = spark.createDataFrame(chain, "path string, content string")
    shown = {r["path"]: (r["origin_path"], r["origin"]) for r in resolve.exported_names(facts.extract(files), files).filter("shown = 'deep'").collect()}
    assert shown == {p: ("src/m40.ts", "deep") for p, _ in chain}


def test_a_cycle_of_classes(spark):
    extends = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "class_id string, base_id string")
    methods = spark.createDataFrame([("c", "run")], "class_id string, method string")
    classes = spark.createDataFrame([("a",), ("b",), ("c",)], "class_id string")
    assert {tuple(r) for r in resolve.dispatched(classes, extends, methods).collect()} == {("a", "run", "c", 2), ("b", "run", "c", 1), ("c", "run", "c", 0)}


def test_reading_a_large_file_is_linear():
    import time

    from tracewell.extract.bindings import Flows

    text = "\n".join(f"export function f{k}(a, b) {{ try {{ g{k}(a); }} catch (e) {{ log(e); }} return b; }}" for k in range(8000))
    for read in (lambda: len(facts.read_file(text)), lambda: len(Flows(text).flows())):
        began = time.perf_counter()
        assert read() > 16000
        assert time.perf_counter() - began < 8


def test_one_pass_over_functions(spark):
    """Dominators, loops, definitions and taint: no rounds over tables of all functions, and lines are sent once."""
    from tracewell.plans import catalog

    for name, most in (("q68_cfg_dominators", 1), ("q69_cfg_back_edges", 1), ("q71_taint_in_functions", 2)):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") <= most and "Scan ExistingRDD" not in plan, plan  # the second deals out the files


def test_loops_and_lines_in_one_pass(spark):
    r = random.Random(8)
    pairs = sorted({(f, k, r.randrange(9)) for f in "abcdefgh" for k in range(9) for _ in range(2)})
    steps = spark.createDataFrame([("p", *x) for x in pairs], "path string, fn string, block int, to int")
    first = spark.createDataFrame([("p", f, 0) for f in "abcdefgh"], "path string, fn string, block int")
    blocks = dataflow.structure(steps, first).cache()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(dataflow.dominated(steps, first)) == rows(dataflow.dominators(blocks))
    back = rows(dataflow.back_edges(steps, blocks).select("path", "fn", "block", "to"))
    assert rows(dataflow.loops(steps, first)) == back and back
    chain = spark.range(700).selectExpr("'p' AS path", "'f' AS fn", "id AS block", "id + 1 AS to")
    assert dataflow.dominated(chain, first.limit(1).selectExpr("'p' AS path", "'f' AS fn", "block")).count() == 701 * 702 // 2


def test_definitions_of_a_large_function_are_shared_out(spark):
    """More definitions than one share has: as a walk finds them, with edges that settle a variable."""
    r = random.Random(2)
    n = 700
    pairs = sorted({(k, r.randrange(n), r.choice(["true", "false"])) for k in range(n) for _ in range(2)})
    made = {(r.randrange(n), v): d for d, v in enumerate("xy" * 600)}
    no = {(k, r.choice(["true", "false"]), "x") for k in range(0, n, 5)}
    steps = spark.createDataFrame([("p", "f", *x) for x in pairs], "path string, fn string, block int, to int, label string")
    defs = spark.createDataFrame([("p", "f", b, d, v) for (b, v), d in made.items()], "path string, fn string, block int, def int, var string")
    refined = spark.createDataFrame([("p", "f", *x) for x in no], "path string, fn string, block int, label string, var string")
    want = set()
    for (block, v), d in made.items():
        todo, seen = [block], set()
        while todo:
            at = todo.pop()
            for a, b, label in pairs:
                if a == at and (a, label, v) not in no and b not in seen:
                    seen.add(b)
                    if (b, v) not in made:
                        todo.append(b)
        want |= {(b, v, d) for b in seen}
    got = [(x["block"], x["var"], x["def"]) for x in dataflow.reaching(defs, steps, refined).collect()]
    assert set(got) == want and len(got) == len(want) and len(made) > 512
