"""Rule files, framework models, package names and resolution."""

import pytest
from pyspark.sql import functions as F

from tracewell.extract import bindings, facts
from tracewell.functions import names
from tracewell.sources import projects, rules
from tracewell.taint import flows, frameworks, resolve, summaries

YAML = """
# rules of a project
version: "1"
globalSources:
  - pattern: event.payload
    kind: event
rules:
  - id: own-sql
    message: 'Raw SQL: no'
    severity: high
    sinks:
      - pattern: $db.rawQuery($sql, ...)
        kind: own-db
        taintedArgs: [0]
    sanitizers:
      - pattern: quoteSql($x)
        sanitizationKind: sql-quote
  - id: off
    enabled: false
    sources:
      - pattern: never.read
"""


def test_yaml_subset():
    got = rules.parse_yaml(YAML)
    assert got["version"] == "1" and got["globalSources"] == [{"pattern": "event.payload", "kind": "event"}]
    assert got["rules"][0]["sinks"] == [{"pattern": "$db.rawQuery($sql, ...)", "kind": "own-db", "taintedArgs": [0]}]
    assert got["rules"][1] == {"id": "off", "enabled": False, "sources": [{"pattern": "never.read"}]}
    assert rules.parse_yaml("a:\n- 1\n- x\nb: [1, 'y', true]\nc:\n  d: ~\n") == {"a": [1, "x"], "b": [1, "y", True], "c": {"d": None}}
    with pytest.raises(ValueError):
        rules.parse_yaml("just words")


@pytest.mark.parametrize("text,kind,name,tainted", [
    ("req.body.**", "read", "req.body", ()), ("eval($code)", "call", "eval", (0,)), ("$db.query(a, $sql, ...)", "call", "*.query", (1,)),
    ("@Body() $param", "decorator", "Body", ()), ("$x.innerHTML = $v", "assignment", "*.innerHTML", (0,)), ("token", "read", "token", ()),
])
def test_patterns(text, kind, name, tainted):
    got = rules.pattern(text)
    assert (got.kind, got.name, got.tainted) == (kind, name, tainted)


def test_rules_merge_by_id_and_collect_errors():
    again = '{"rules": [{"id": "own-sql", "sinks": [{"pattern": "other($x)"}]}, {"sinks": []}]}'
    got = rules.merged({"a.yml": YAML, "b.json": again, "c.json": "{", "d.yml": "rules:\n  - id: z\n    sinks:\n      - pattern: '(('\n"})
    assert set(got.rules) == {"own-sql", "off", "z"}
    assert [p.name for p, _ in got.found["sinks"]] == ["other"] and [p.name for p, _ in got.found["sources"]] == ["event.payload"]
    assert {f for f, _ in got.errors} == {"b.json", "c.json", "d.yml"}


def project(spark, files, names_=None, model=False):
    made = spark.createDataFrame(list(files.items()), "path string, content string")
    read, bound = facts.extract(made).cache(), bindings.extract(made).cache()
    if model:
        bound = frameworks.normalized(bound, frameworks.routes(bound, read)).cache()
    s = summaries.build(bound, resolve.links(bound, read, made), names_)
    return {(r["source_kind"], r["sink_kind"], r["sanitized"]) for r in flows.forward(s, include_sanitized=True).collect()}, read, bound


def test_rules_add_sources_sinks_and_sanitizers(spark, tmp_path):
    (tmp_path / ".tracewell-taint.yml").write_text(YAML)
    (tmp_path / ".tracewell" / "taint-rules").mkdir(parents=True)
    (tmp_path / ".tracewell" / "taint-rules" / "x.json").write_text('{"rules": [{"id": "x", "sinks": [{"pattern": "danger($v)", "kind": "own"}]}]}')
    own = rules.load(spark, str(tmp_path))
    assert not own.errors and set(own.rules) == {"own-sql", "off", "x"}
    code = {"a.ts": "function f(event, store) { const v = event.payload.id; store.rawQuery(v); store.rawQuery('x', v); }\nfunction g(event, store) { store.rawQuery(quoteSql(event.payload)); danger(event.payload); }\n"}
    assert project(spark, code, own.catalogue())[0] == {("event", "own-db", False), ("event", "own-db", True), ("event", "own", False)}
    assert project(spark, code)[0] == set()
    assert rules.load(spark, str(tmp_path / "none")).rules == {}


def test_framework_handlers_whatever_their_request_is_called(spark):
    code = {
        "src/app.ts": "import express from 'express';\nconst app = express();\napp.post('/u', requireAuth, validate(schema), (r, w) => { db.query(r.body.id); });\nfunction show(q, res) { eval(q.query.x); }\napp.get('/s', show);\n",
        "src/app/users/route.ts": "export async function POST(request) { const d = request.body; exec(d); }\n",
        "src/c.ts": "import { Controller, Post, Body } from '@nestjs/common';\nclass C {\n  @Post('/x')\n  make(@Body() dto) { return db.query(dto.name); }\n}\n",
    }
    found, read, bound = project(spark, code, model=True)
    assert found == {("req-body", "db-query", False), ("req-query", "eval", False), ("req-body", "command-exec", False)}
    assert {r["framework"] for r in frameworks.detected(read).collect()} == {"express", "nestjs"}
    routes = frameworks.routes(bindings.extract(spark.createDataFrame(list(code.items()), "path string, content string")), read)
    got = {(r["framework"], r["method"], r["route"]): r["middleware"] for r in routes.collect()}
    assert set(got) == {("express", "post", "/u"), ("express", "get", "/s"), ("nextjs", "post", "/users"), ("nestjs", "post", "/x")}
    assert {tuple(r["effects"]) for r in frameworks.effects(routes).filter("size(effects) > 0").collect()} == {("auth", "validation")} or got["express", "post", "/u"][0] == "requireAuth"


@pytest.mark.parametrize("name,want", [
    ("react", None), ("@x/react", None), ("axois", ("axios", 1, "high")), ("cross_env", ("cross-env", 1, "high")), ("body_parser", ("body-parser", 1, "high")), ("expresz", ("express", 1, "high")),
    ("jsonwebtokenxx", ("jsonwebtoken", 2, "medium")), ("jsonwebtokenxxx", ("jsonwebtoken", 3, "medium")), ("left-pad-of-mine", None),
])
def test_typosquats(spark, name, want):
    got = spark.createDataFrame([(name,)], "name string").select(names.typosquat(F.col("name")).alias("t")).first()["t"]
    assert (got and tuple(got)) == want


def test_shapes_of_slips(spark):
    rows = [("cross_env", "cross-env", True), ("expres", "express", True), ("expresss", "express", True), ("reatc", "react", True), ("l0dash", "lodash", True), ("1odash", "lodash", True), ("redact", "react", False), ("abc", "react", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.filter(names.squat_shape(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_packages_are_looked_up_along_the_folders(spark):
    files = [
        ("r/package.json", '{"name": "top", "dependencies": {"a": "1"}, "workspaces": ["w/*"]}'), ("r/w/one/package.json", '{"name": "@s/one", "dependencies": {"hoisted": "1"}}'),
        ("r/x/package.json", '{"name": "x", "devDependencies": {"near": "1"}}'), ("r/yarn.lock", 'deep@^1:\n  version "1"\n'),
    ]
    imports = [("r/x/src/f.ts", p) for p in ("a", "near", "x", "top", "@s/one", "hoisted", "deep", "inst", "gone")] + [("r/y/f.ts", "near"), ("r/y/f.ts", "inst")]
    modules = projects.installed(spark.createDataFrame([("r/x/node_modules/inst/package.json",), ("r/x/node_modules/@q/z/package.json",)], "path string"))
    assert {tuple(r) for r in modules.collect()} == {("r/x", "inst"), ("r/x", "@q/z")}
    good = projects.importable(spark.createDataFrame(imports, "path string, package string"), spark.createDataFrame(files, "path string, content string"), modules)
    assert {tuple(r) for r in good.collect()} == {i for i in imports if i[1] != "gone"} - {("r/y/f.ts", "near"), ("r/y/f.ts", "inst")}
