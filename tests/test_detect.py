"""Own snippets that fire and that do not, for each engine: one parse and one job for all."""

import pytest
from pyspark.sql import functions as F

from tracewell.detect import engines
from tracewell.extract import facts
from tracewell.extract.tokens import Source

FIRE = {
    "hallucinated-deps": ["import x from 'expresss';", "const y = require('not-there/sub');", "export * from '@no/where/x';"],
    "stack-trace-exposure": ["app.get('/a', (req, res) => { res.json({ message: err.stack }); });", "res.status(500).send(error);"],
    "missing-await": ["async function go() { await 1; }\nasync function f() { try { go(); } catch (e) { throw e; }\n x(); }", "async function f() { user.repository.save(u); done(); }", "async function f() { fetch('/x'); g(); }"],
    "async-foreach": ["items.forEach(async (i) => { await go(i); });", "xs.filter(async (x) => check(x));"],
    "empty-catch": ["try { a(); } catch (e) { }", "try { a(); } catch { return; }", "try { a(); } catch (e) { console.error('failed'); }"],
    "hardcoded-secret": ["const k = 'sk_live_abcdefghijklmnop1234';", "const apiKey = 'f3Zk9qLm2Xw8Rt5Yb7Nc4Vd1';", "const u = 'postgres://bob:hunter22@db.internal/x';"],
    "unsafe-regex": ["const r = /(a+)+$/;", "const r = /(.*)*x/;", "const r = new RegExp(req.query.q);"],
    "console-in-production": ["console.log('x');", "console.log(user.password);"],
    "missing-input-validation": ["app.post('/u', (req, res) => { db.users.create(req.body); });"],
    "idor": ["app.get('/o/:id', async (req, res) => { const o = await db.orders.findById(req.params.id); res.json(o); });"],
}
QUIET = {
    "hallucinated-deps": ["import fs from 'node:fs'; import { a } from './a'; import t from 'lodash/fp'; import type { X } from 'gone'; import y from '@/x';", "await import('maybe').catch(() => null);"],
    "stack-trace-exposure": ["logger.error(err.stack);", "res.json({ ok: true });", "res.json(process.env.NODE_ENV === 'development' ? { s: err.stack } : {});"],
    "missing-await": ["async function go() {}\nasync function f() { await go(); void go(); return go(); }", "async function f() { fetch('/x').catch(log); const p = fetch('/y'); }", "function f() { fetch('/x'); }"],
    "async-foreach": ["await Promise.all(items.map(async (i) => go(i)));", "items.forEach((i) => go(i));", "const r = xs.map(async (x) => x);"],
    "empty-catch": ["try { a(); } catch (e) { throw e; }", "try { a(); } catch (e) { handle(e); }", "p.catch(() => {});"],
    "hardcoded-secret": ["const k = process.env.SECRET_KEY;", "const password = 'your-password-here-now';", "const u = 'postgres://bob:hunter22@localhost/x';", "const token = `${a}-aaaaaaaaaaaa`;"],
    "unsafe-regex": ["const r = /^[a-z]+$/;", "const r = new RegExp('abc');", "const q = a / b / c;"],
    "console-in-production": ["logger.info('x');", "my.console2.log(1);"],
    "missing-input-validation": ["app.post('/u', validate(schema), (req, res) => { db.users.create(req.body); });", "app.post('/u', (req, res) => { const b = Body.parse(req.body);\n db.users.create(b); });", "app.get('/h', (req, res) => res.send('ok'));"],
    "idor": ["app.get('/o/:id', async (req, res) => { const o = await db.orders.findOne({ id: req.params.id, userId: req.user.id }); });", "app.get('/o/:id', requireAdmin, async (req, res) => { await db.orders.findById(req.params.id); });"],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"src/{kind}/{engine}/{k}.ts", code) for kind, cases in (("fire", FIRE), ("quiet", QUIET)) for engine, codes in cases.items() for k, code in enumerate(codes)]
    files = spark.createDataFrame(rows, "path string, content string")
    known = spark.createDataFrame([("lodash",), ("express",)], "name string")
    read = facts.extract(files).cache()
    assert facts.of_kind(read, "error").count() == 0
    out = {(r["engine"], r["path"]) for r in engines.created(engines.detect(read, known), files).select("engine", "path").collect()}
    read.unpersist()
    return out


@pytest.mark.parametrize("engine", sorted(FIRE))
def test_fires(found, engine):
    for k, code in enumerate(FIRE[engine]):
        assert (engine, f"src/fire/{engine}/{k}.ts") in found, code


@pytest.mark.parametrize("engine", sorted(QUIET))
def test_stays_quiet(found, engine):
    for k, code in enumerate(QUIET[engine]):
        assert (engine, f"src/quiet/{engine}/{k}.ts") not in found, code


def test_rules_and_suppression(spark):
    files = spark.createDataFrame([("src/a.ts", "// tracewell-disable-next-line\nconsole.log(1);\nconsole.log(2);"), ("tests/a.ts", "try { a(); } catch (e) {}")], "path string, content string")
    known = spark.createDataFrame([], "name string")
    read = facts.extract(files)
    all_ = engines.created(engines.detect(read, known, {"console-in-production": "error", "idor": "off"}), files)
    got = {(r["path"], r["line"], r["severity"], r["confidence"]) for r in all_.collect()}
    assert got == {("src/a.ts", 3, "error", "medium"), ("tests/a.ts", 1, "error", "medium")}
    assert engines.detect(read, known, dict.fromkeys(engines.ENGINES, "off")).count() == 0


@pytest.mark.parametrize("text", ["", "`${`", "/", "'", "}}}((", "/* x", "a = b / c / d", "x = /[/]/g", " ", "#!/usr/bin/env node\nx()", "catch", "import", "export {", "function", "=>", "(" * 500])
def test_any_text_is_read(text):
    facts.read_file(text)


def test_slashes_and_templates():
    kinds = [(t.kind, t.text) for t in Source("a = b / c; d = /x\\/[/]y/g; `a${`b`}c` // end").tokens]
    assert ("regex", "/x\\/[/]y/g") in kinds and ("template", "`a${`b`}c`") in kinds and kinds.count(("mark", "/")) == 1


def test_functions_and_scopes():
    rows = facts.read_file("export async function a(x) { b(); }\nclass C extends D { async m() { n(); } }\nconst f = async (y) => g(y);")
    functions = {r["name"]: r["about"] for r in rows if r["kind"] == "function"}
    assert functions["a"]["exported"] == "true" and functions["m"]["async"] == "true" and functions["f"]["params"] == "y"
    assert {r["name"]: r["scope"] for r in rows if r["kind"] == "call"} == {"b": "a", "n": "m", "g": "f"}


def test_source_text_is_read_to_its_end(spark):
    """What stands after the first thousands of characters of a handler, a parameter list or a literal counts as well."""
    much = "log(1);\n" * 600
    handler = "app.post('/u', (req, res) => {\n" + much + "%s });"
    codes = {
        "input": handler % "db.users.create(req.body);",
        "schema": handler % "const zodded = 1; db.users.create(req.body);",
        "guard": "app.get('/o/:id', async (req, res) => {\n" + much + "if (requireAdmin) { await db.orders.findById(req.params.id); } });",
        "stack": "res.json({ a: '" + "x" * 3000 + "', message: err.stack });",
    }
    files = spark.createDataFrame([(f"src/{k}.ts", v) for k, v in codes.items()], "path string, content string")
    read = facts.extract(files)
    got = {(r["engine"], r["path"], r["severity"]) for r in engines.detect(read, spark.createDataFrame([], "name string")).filter("engine IN ('missing-input-validation', 'stack-trace-exposure') OR engine = 'idor' AND path = 'src/guard.ts'").collect()}
    assert got == {("missing-input-validation", "src/input.ts", "error"), ("missing-input-validation", "src/guard.ts", "info"), ("stack-trace-exposure", "src/stack.ts", "error")}
    rows = facts.read_file(f"function f({', '.join(f'parameter{k}' for k in range(400))}) {{ try {{ a(); }} catch (e) {{ {much} }} }} const s = '{'y' * 5000}';")
    assert next(r for r in rows if r["kind"] == "function" and r["name"] == "f")["about"]["params"].endswith("parameter399")
    assert len(next(r for r in rows if r["kind"] == "literal")["name"]) == 5000 and len(next(r for r in rows if r["kind"] == "catch")["about"]["body"]) > 4000


def test_long_facts_come_in_several_batches(spark):
    files = spark.createDataFrame([(f"src/{k}.ts", "a(b(c('some text that is long')));") for k in range(5)], "path string, content string")
    want = sorted((f"src/{k}.ts", ix) for k in range(5) for ix in range(4))
    assert sorted((r["path"], r["ix"]) for r in facts.extract(files, step=50).collect()) == want


def test_handlers_of_any_length_are_searched(spark):
    filler = "".join(f"  step{k}();\n" for k in range(1200))
    code = f"app.post('/u', async (req, res) => {{\n{filler}  db.users.create(req.body);\n}});\n"
    assert len(code) > 10_000
    files = spark.createDataFrame([("src/a.ts", code)], "path string, content string")
    found = engines.detect(facts.extract(files), spark.createDataFrame([], "name string"))
    assert "missing-input-validation" in {r["engine"] for r in found.select("engine").collect()}


def test_an_engine_that_fails_does_not_stop_the_others(spark):
    files = spark.createDataFrame([("src/a.ts", "try { a(); } catch (e) { }")], "path string, content string")
    engines.register("broken", lambda facts: facts.select("no_such_column"))
    try:
        failed = []
        found = engines.detect(facts.extract(files), spark.createDataFrame([], "name string"), failed=failed)
        assert [name for name, _ in failed] == ["broken"] and found.filter("engine = 'empty-catch'").count() == 1
    finally:
        del engines.ENGINES["broken"]


NEAR = {
    "bounded": ["app.post('/p', (req, res) => { const lines = req.body.text.split('\\n'); lines.map(line => line.match(/(a+)+$/)); });", "app.post('/c', (req, res) => { const ch = req.body.text.charAt(0); const m = ch.match(/(a+)+$/); });",
        "app.post('/v', (req, res) => { const p = req.body.content.substring(0, 100); p.match(/(a+)+$/); });", "app.post('/f', (req, res) => { for (const line of req.body.text.split('\\n')) { line.match(/(a+)+$/); } });", "x.slice(0, 9).replace(/(a+)+$/, '');"],
    "input": ["app.post('/c', (req, res) => { const ok = req.body.text.match(/(a+)+$/); });", "function f(req) { const r = /(a+)+$/; return r.test(req.query.q); }", "req.query.q.search(/(a+)+$/);"],
    "route": ["app.get('/x', (req, res) => { if (/(a+)+$/.test(name)) res.end(); });", "router.use(async (ctx) => { return /(a+)+$/.test(x); });"],
    "validator": ["function validateName(s) { return /(a+)+$/.test(s); }", "const parseIt = (s) => new RegExp('(a+)+$').test(s);"],
    "": ["const r = /(a+)+$/;", "app.use((req, res, next) => { /(a+)+$/.test(x); });", "new RegExp('(\\\\d+)+');"],
}


@pytest.mark.parametrize("near", NEAR)
def test_where_a_pattern_is_used(near):
    for code in NEAR[near]:
        assert [r["about"]["near"] for r in facts.read_file(code) if r["kind"] == "regex"] == [near], code


def test_severity_of_patterns_by_place(spark):
    rows = [(f"{near or 'none'}/{k}.ts", code) for near, codes in NEAR.items() for k, code in enumerate(codes)]
    found = engines.unsafe_regex(facts.extract(spark.createDataFrame(rows, "path string, content string"))).filter("message LIKE '%without end%'").collect()
    assert {r["path"]: r["severity"] for r in found} == {p: "error" if p.split("/")[0] in ("input", "route", "validator") else "warning" for p, _ in rows}


def test_gaps_between_fields_read_and_checked(spark):
    code = {
        "dots": "app.post('/a', body('name').isString(), (req, res) => { save(req.body.name, req.body.role, req.query.q); });",
        "taken": "app.post('/a', [body(['name', 'age'])], (req, res) => { const { name, age: years, role = 1, ...rest } = req.body; save(name, req.body.name); });",
        "any": "router.put('/a/:id', check('id'), (req, res) => { load(req.params.id); load(req.params['id']); });",
        "tested": "app.post('/a', (req, res) => { if (typeof req.body.n !== 'number') return; if (!req.body.m) return; save(req.body.n, req.body.m); });",
        "none": "app.get('/a', (req, res) => { res.send('ok'); });",
    }
    rows = engines.field_gaps(facts.extract(spark.createDataFrame(list(code.items()), "path string, content string"))).collect()
    got = {(r["path"], r["source"]): (sorted(r["accessed"]), sorted(r["covered"]), sorted(r["weak"]), sorted(r["missing"])) for r in rows}
    assert got == {
        ("dots", "body"): (["name", "role"], ["name"], [], ["role"]), ("dots", "query"): (["q"], [], [], ["q"]),
        ("taken", "body"): (["age", "name", "role"], ["age", "name"], [], ["role"]), ("any", "params"): (["id"], ["id"], [], []), ("tested", "body"): (["m", "n"], ["n"], ["m"], ["m"]),
    }
    found = engines.missing_input_validation(facts.extract(spark.createDataFrame(list(code.items()), "path string, content string"))).collect()
    assert sorted((r["path"], r["message"]) for r in found) == [
        ("dots", "Partial validation gap: req.body.{ role } not covered"), ("dots", "Partial validation gap: req.query.{ q } not covered"),
        ("taken", "Partial validation gap: req.body.{ role } not covered"), ("tested", "Partial validation gap: req.body.{ m } not covered"),
    ]


def test_an_engine_that_fails_in_a_task_is_reported(spark, monkeypatch):
    monkeypatch.setattr(engines, "ENGINES", dict(engines.ENGINES))
    broken = lambda read: engines._issues(facts.of_kind(read, "regex").withColumn("x", F.raise_error(F.lit("broken engine"))).filter("x IS NULL"), "broken", "error", "high", F.lit("m"), "s")
    engines.register("broken", broken)
    read = facts.extract(spark.createDataFrame([("a.ts", "const r = /(a+)+$/;")], "path string, content string"))
    known = spark.createDataFrame([("express",)], "name string")
    failed = []
    assert [r["engine"] for r in engines.detect(read, known, failed=failed).collect()] == ["unsafe-regex"]
    assert [n for n, _ in failed] == ["broken"] and "broken engine" in failed[0][1]


def test_async_functions_of_other_files(spark):
    """Over a re-export, as a default and as a member of a module; what is awaited, voided, shadowed by no import or not async is left."""
    code = {
        "src/lib.ts": "export async function load(x) { return x; }\nexport function plain(x) { return x; }\nexport default async function main(x) { return x; }\n",
        "src/all.ts": "export * from './lib';\n",
        "src/a.ts": "import { load as go, plain } from './all';\nimport start from './lib';\nasync function f(v) {\n  go(v);\n  plain(v);\n  start(v);\n  await go(v);\n  void go(v);\n  return go(v);\n}\n",
        "src/b.ts": "import * as lib from './lib';\nasync function f(v) {\n  lib.load(v);\n  lib.plain(v);\n  load(v);\n  end(v);\n}\nfunction g(v) { lib.load(v); }\n",
        "src/c.ts": "import { push } from 'q';\nasync function f(v) {\n  push(v);\n  push(v).catch(log);\n  end(v);\n}\n",
    }
    files = spark.createDataFrame(list(code.items()), "path string, content string")
    read = facts.extract(files).cache()
    found = {(r["path"], r["line"], r["severity"], r["confidence"]) for r in engines.missing_await(read, files).collect()}
    assert found == {("src/a.ts", 4, "error", "high"), ("src/a.ts", 6, "error", "high"), ("src/b.ts", 3, "error", "high"), ("src/c.ts", 3, "warning", "medium")}
    known = spark.createDataFrame([("q",)], "name string")
    every = engines.detect(read, known, files=files).filter("engine = 'missing-await'")
    assert {(r["path"], r["line"]) for r in every.collect()} == {f[:2] for f in found}
    assert {r["path"] for r in engines.missing_await(read).collect()} == {"src/a.ts", "src/c.ts"}  # without the other files: awaited elsewhere alone


def test_parsed_rows_are_not_sent_whole(spark):
    """The planner takes what is parsed from a table of keys for small at any size; q90's joins must not bring it to the driver."""
    from tracewell.plans import catalog

    plan = catalog.queries()["q90_calls_without_await"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan


def test_files_are_parsed_once_for_all_engines(spark):
    from tracewell.plans import catalog

    plan = catalog.queries()["q63_made_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan, plan
