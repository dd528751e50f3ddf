import json

from tracewell import cli


def test_a_project_from_scan_to_report(spark, tmp_path, capsys):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "package.json").write_text('{"name": "p", "dependencies": {"express": "4"}}')
    (root / ".gitignore").write_text("old/\n")
    (root / "src/a.ts").write_text("import express from 'express';\nimport gone from 'not-installed';\ntry { a(); } catch (e) {}\nconst key = 'sk_live_abcdefghijklmnop1234';\n")
    (root / "src/a.test.ts").write_text("try { a(); } catch (e) {}")
    (root / "old").mkdir()
    (root / "old/b.ts").write_text("try { a(); } catch (e) {}")
    out = str(tmp_path / "r.json")
    assert cli.main([str(root), "--output", out], spark) == 1
    doc = json.load(open(out))
    assert [(i["engine"], i["severity"], i["location"]["line"]) for i in doc["issues"]] == [("hallucinated-deps", "warning", 2), ("empty-catch", "warning", 3), ("hardcoded-secret", "error", 4)]
    assert doc["summary"]["totalFiles"] == 3 and doc["summary"]["analyzedFiles"] == 1

    base = str(tmp_path / "base")
    assert cli.main([str(root), "--baseline", base], spark) == 0
    assert cli.main([str(root), "--compare-baseline", base, "--format", "compact"], spark) == 0
    assert capsys.readouterr().out.strip() == ""
    assert cli.main([str(root), "--format", "compact", "--min-priority", "critical", "--fail-on", "none"], spark) == 0
    assert "[hardcoded-secret] error:" in capsys.readouterr().out


def test_formats():
    assert cli.format_of(None, "x.sarif") == "sarif" and cli.format_of("compact", "x.json") == "compact"


def test_flows_of_a_project(spark, tmp_path, capsys):
    root = tmp_path / "q"
    (root / "src").mkdir(parents=True)
    (root / "src/app.ts").write_text("import { find } from './db';\napp.get('/u', (r, w) => { find(r.query.id); });\n")
    (root / "src/db.ts").write_text("export function find(id) { return db.query('x' + id); }\n")
    assert cli.main([str(root), "--flows"], spark) == 1
    said = capsys.readouterr().out
    assert "CRITICAL" in said and "possible SQL injection" in said and "db.ts#find" in said
    out = str(tmp_path / "f.sarif")
    assert cli.main([str(root), "--flows", "--fail-on", "none", "--output", out], spark) == 0
    run = json.load(open(out))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["taint/db-query"]
    assert run["results"][0]["codeFlows"][0]["threadFlows"][0]["locations"][-1]["nestingLevel"] == 0  # the level before the step, as calls nest what comes behind them


def test_configuration_is_looked_for_upwards(tmp_path):
    from tracewell.sources import projects

    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "tracewell.config.json").write_text("{}")
    assert projects.upward(str(tmp_path / "a/b"), projects.CONFIG_NAMES) == str(tmp_path / "tracewell.config.json")
    assert projects.upward(str(tmp_path / "a/b"), ("no-such-name.json",)) is None
