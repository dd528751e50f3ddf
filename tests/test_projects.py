import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from tracewell.operators import incremental, report, sinks
from tracewell.sources import baselines, projects
from tracewell.streaming import findings

FILES = [
    ("package.json", json.dumps({"name": "root", "workspaces": ["packages/*"], "dependencies": {"express": "1"}, "devDependencies": {"jest": "1"}})),
    ("packages/a/package.json", json.dumps({"name": "@x/a", "workspaces": {"packages": ["sub/**"]}, "peerDependencies": {"react": "1"}})),
    ("packages/a/sub/q/r/package.json", '{"name": "deep"}'),
    ("other/package.json", "{bad json"),
    ("package-lock.json", json.dumps({"packages": {"": {}, "node_modules/chalk": {}, "node_modules/@types/node": {}}})),
    ("yarn.lock", "left-pad@1:\n"),
]


def test_manifests_workspaces_and_locks(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    read = projects.manifests(files)
    assert {(r["dir"], r["name"]) for r in projects.dependencies(read).collect()} == {("", "express"), ("", "jest"), ("packages/a", "react")}
    assert {(r["name"], r["dir"]) for r in projects.workspaces(read).collect()} == {("@x/a", "packages/a"), ("deep", "packages/a/sub/q/r")}
    assert {r["name"] for r in projects.locked_packages(files).collect()} == {"chalk", "@types/node"}
    assert {r["name"] for r in projects.known_packages(files).collect()} == {"root", "@x/a", "deep", "express", "jest", "react", "chalk", "@types/node"}


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [("bun.lock", '{\n    "zod": ["zod@1"],\n  "w": [\n}', {"zod"}), ("yarn.lock", '"@a/b@^1", x@2:\n  v\nlodash@4:\n', {"@a/b", "lodash"}), ("pnpm-lock.yaml", "packages:\n  /react@18:\n  '@a/b@1':\n", {"react", "@a/b"})],
)
def test_lockfiles(spark, name, text, want):
    assert {r["name"] for r in projects.locked_packages(spark.createDataFrame([(name, text)], "path string, content string")).collect()} == want


def test_aliases_follow_extends_once():
    texts = {"tsconfig.json": '{"extends": "./base", // c\n "compilerOptions": {"paths": {"@/*": ["src/*"], "@config": ["c"],}}}', "base.json": '{"extends": "./tsconfig.json", "compilerOptions": {"paths": {"#/*": []}}}', "tsconfig.app.json": "nope"}
    assert projects.aliases(texts) == {"@/", "@config", "#/"}


def test_config_merges():
    c = projects.Config.merged('{"rules": {"idor": "off"}, "failOn": "warn"}')
    assert not c.enabled("idor") and c.enabled("new-rule") and c.rules["missing-await"] == "warn" and c.fail_on == "warn"
    assert projects.Config.merged("not json") == projects.Config()


def test_files_are_found_and_scanned(spark, tmp_path):
    for name in ("src/a.ts", "src/b.test.ts", "src/c.py", "gen/x-1a2b3c4d5.js", "keep/d.jsx"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"// {name}")
    found = projects.source_files(spark, str(tmp_path))
    assert {r["path"].split("/")[-1]: r["script_kind"] for r in found.collect()} == {"a.ts": "ts", "b.test.ts": "ts", "x-1a2b3c4d5.js": "js", "d.jsx": "jsx"}
    from tracewell.sources import ignore

    kept = projects.scanned(found, projects.Config(), ignore.parse(["keep/"]))
    assert [r["path"].split("/")[-1] for r in kept.collect()] == ["a.ts"]


def test_imports_resolve_to_the_first_that_exists(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/u/index.js",), ("src/b.js",), ("src/b.ts",), ("lib/z.tsx",)], "path string")
    imports = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "./u"), ("src/u/index.js", "../a"), ("src/a.ts", "@/z"), ("src/a.ts", "react"), ("src/a.ts", "./gone")], "path string, name string")
    got = {(r["path"], r["name"]): r["target"] for r in projects.resolved(imports, files, {"@/": "lib/"}).collect()}
    assert got == {("src/a.ts", "./b"): "src/b.ts", ("src/a.ts", "./u"): "src/u/index.js", ("src/u/index.js", "../a"): "src/a.ts", ("src/a.ts", "@/z"): "lib/z.tsx", ("src/a.ts", "react"): None, ("src/a.ts", "./gone"): None}


def test_workspace_prefixes(spark):
    df = spark.createDataFrame([("packages/api-utils/x.ts",)], "p string")
    spaces = [("api", "packages/api"), ("utils", "packages/api-utils")]
    assert df.select(projects.workspace_of(F.col("p"), spaces), projects.workspace_of(F.col("p"), spaces, True)).first()[:] == ("api", "utils")


ISSUES = "ord long, engine string, severity string, confidence string, file_path string, line int, message string, suggestion string"


@pytest.fixture(scope="module")
def issues(spark):
    rows = [(1, "idor", "error", None, "/p/a.ts", 3, 'say "x"', "fix"), (2, "empty-catch", "info", "low", "/p/b/c.ts", 9, "<b>", None), (3, "idor", "warning", "medium", "/p/a.ts", 4, "m", None)]
    return spark.createDataFrame(rows, ISSUES)


def test_json_and_sarif_documents(issues, tmp_path):
    sinks.write_json(issues, f"{tmp_path}/r.json", 5, 4, rules={"idor": "error", "x": "off"})
    doc = json.load(open(f"{tmp_path}/r.json"))
    assert doc["summary"]["totalIssues"] == 3 and doc["summary"]["criticalIssues"] == 1 and doc["config"]["rulesEnabled"] == ["idor"]
    assert [i["filePath"] for i in doc["issues"]] == ["/p/a.ts", "/p/b/c.ts", "/p/a.ts"] and doc["issues"][0]["location"] == {"line": 3, "column": 1}
    sinks.write_sarif(issues, f"{tmp_path}/r.sarif", "/p")
    run = json.load(open(f"{tmp_path}/r.sarif"))["runs"][0]
    assert [(r["id"], r["defaultConfiguration"]["level"]) for r in run["tool"]["driver"]["rules"]] == [("idor", "error"), ("empty-catch", "note")]
    assert run["results"][1]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "b/c.ts" and "fixes" not in run["results"][1]
    sinks.write_sarif(issues.limit(0), f"{tmp_path}/e.sarif")
    assert json.load(open(f"{tmp_path}/e.sarif"))["runs"][0]["results"] == []


def test_text_sinks(issues, tmp_path):
    assert [r["value"] for r in sinks.compact_rows(issues).collect()] == ['/p/a.ts:3:1 [idor] error: say "x"', "/p/a.ts:4:1 [idor] warning: m", "/p/b/c.ts:9:1 [empty-catch] warning: <b>"]
    assert sinks.detailed_rows(issues).count() == 2
    assert "... and 1 more" in sinks.grouped_text(issues, "engine", 1)
    assert sinks.summary_text(issues).startswith("3 issues: 1 errors")
    sinks.write_csv(issues, f"{tmp_path}/csv")
    rows = [r for f in glob.glob(f"{tmp_path}/csv/*.csv") for r in csv.reader(open(f))]
    assert list(sinks.CSV) in rows and ["error", "high", "/p/a.ts", "3", "idor", 'say "x"', "fix"] in rows
    sinks.write_html(issues, f"{tmp_path}/r.html")
    assert "&lt;b&gt;" in open(f"{tmp_path}/r.html").read()
    assert sinks.exit_status(issues) == 1 and sinks.exit_status(issues, "none") == 0 and sinks.exit_status(issues.filter("severity = 'info'"), "warn") == 0


def test_baselines(spark, tmp_path):
    path = f"{tmp_path}/base"
    assert baselines.load(spark, path) is None
    baselines.save(spark.createDataFrame([("a",), ("a",), ("b",)], "fingerprint string"), path)
    base = baselines.load(spark, path)
    assert base.count() == 3
    now = spark.createDataFrame([("a",), ("c",), ("c",)], "fingerprint string")
    assert [r[0] for r in report.new_against(now, base).collect()] == ["c", "c"]
    (tmp_path / "one.json").write_text('{\n "version": "1",\n "fingerprints": ["x", "y"]\n}')
    assert {r[0] for r in baselines.load(spark, f"{tmp_path}/one.json").collect()} == {"x", "y"}
    (tmp_path / "bad.json").write_text("{no")
    assert baselines.load(spark, f"{tmp_path}/bad.json") is None


def test_watched_files_are_reported_once(spark, tmp_path):
    source = tmp_path / "in"
    seen = []

    def go():
        stream = spark.readStream.schema("path string, content string").json(str(source))
        findings.watch_files(stream, f"{tmp_path}/snap", f"{tmp_path}/cp", lambda df, n: seen.append(sorted(r["path"] for r in df.collect()))).awaitTermination()

    spark.createDataFrame([("a", "1"), ("b", "1")], "path string, content string").write.mode("append").json(str(source))
    go()
    spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "path string, content string").write.mode("append").json(str(source))
    go()
    assert seen == [["a", "b"], ["b", "c"]]
    assert incremental.compared(incremental.snapshot(spark.createDataFrame([("a", "1")], "path string, content string")), findings._snapshot(spark, f"{tmp_path}/snap")).count() == 3


def test_streamed_counts_and_baseline(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:01' ts, 'idor' engine, 'f1' fingerprint UNION ALL SELECT timestamp'2024-01-01 00:00:02', 'idor', 'f2'").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, engine string, fingerprint string").parquet(f"{tmp_path}/in")
    new = findings.only_new(stream, spark.createDataFrame([("f1",)], "fingerprint string"))
    q = findings.counted(new).writeStream.format("memory").queryName("tracewell_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["engine"], r["findings"]) for r in spark.table("tracewell_counts").collect()] == [("idor", 1)]
