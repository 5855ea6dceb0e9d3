import json

import pytest

from hazardlens.plans import app, config, findings, render
from hazardlens.sources.python_files import EXAMPLE


@pytest.fixture
def project(tmp_path, spark):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text(EXAMPLE)
    (tmp_path / ".hid").mkdir()
    (tmp_path / ".hid/b.py").write_text(EXAMPLE)
    (tmp_path / "cov.json").write_text(json.dumps({"files": {"/ci/src/a.py": {"executed_lines": [7, 8], "missing_lines": [9]}}}))
    return tmp_path


def test_scan_baseline_check(project, capsys):
    root, snap = str(project), str(project / "snap")
    assert app.main(["scan", root, "--coverage", f"{root}/cov.json", "--format", "json"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {r["path"] for r in rows} == {"src/a.py"} and len(rows) == 5
    assert app.main(["scan", root, "--fail-above", "1"]) == 1
    for how in ("sarif", "markdown", "github", "pr-comment"):
        assert app.main(["scan", root, "--format", how]) == 0
    assert app.main(["baseline", root, "--snapshot", snap]) == 0
    assert app.main(["check", root, "--snapshot", snap]) == 0
    assert app.main(["explain", root, "--target", "src/a.py::plain"]) == 0
    assert app.main(["check", root]) == 2


def test_snapshot_json_round_trip(project, spark, capsys):
    root, snap, folder = str(project), str(project / "snap.json"), str(project / "snap")
    assert app.main(["baseline", root, "--snapshot", snap]) == app.main(["baseline", root, "--snapshot", folder]) == 0
    text = json.loads((project / "snap.json").read_text())
    assert text["version"] == "3" and len({(e["path"], e["qualname"]) for e in text["entries"]}) == len(text["entries"]) > 0
    own = ["path", "qualname", "score", "fingerprint", "signature", "language", "churn", "sprawl"]
    rows = lambda p: sorted(map(tuple, app.load_snapshot(spark, p).select(own).collect()))
    assert rows(snap) == rows(folder)
    capsys.readouterr()
    assert app.main(["check", root, "--snapshot", snap]) == 0
    shown = capsys.readouterr().out
    assert shown.strip() == "nothing to report"
    assert app.main(["diff", root, "--snapshot", snap]) == 0
    shown = capsys.readouterr().out
    assert "unchanged" in shown and "regressed" not in shown


def test_check_and_diff_formats(project, capsys):
    root, snap = str(project), str(project / "snap")
    (project / "pyproject.toml").write_text("[tool.hazardlens]\nregression_above = 0.5\nnew_above = 0\n")
    assert app.main(["baseline", root, "--snapshot", snap, "--coverage", f"{root}/cov.json"]) == 0
    longer = EXAMPLE.replace("    return None\n", "    for i in a:\n        if i and a or i > 2:\n            while i:\n                i -= 1\n    return None\n", 1)
    (project / "src/a.py").write_text(longer + "\n\ndef added(x):\n    return x\n")
    out = {}
    for command in ("check", "diff"):
        for how in ("table", "json", "markdown", "sarif", "github", "pr-comment"):
            assert app.main([command, root, "--snapshot", snap, "--format", how]) == int(command == "check")
            out[command, how] = capsys.readouterr().out
    check, diff = json.loads(out["check", "json"]), json.loads(out["diff", "json"])
    assert {e["label"] for e in check["entries"]} >= {"new_above_threshold"} and sum(check["summary"].values()) == len(check["entries"])
    assert {e["target"]: e["label"] for e in diff["entries"]}["src/a.py::added"] == "new"
    assert all(e["reason"] for e in check["entries"] + diff["entries"])
    found = json.loads(out["check", "sarif"])["runs"][0]["results"]
    assert len(found) == len(check["entries"]) and all(r["locations"][0]["physicalLocation"]["region"]["startLine"] > 1 for r in found)
    assert any("line=" in x for x in out["check", "github"].splitlines()) and "unchanged" not in out["diff", "pr-comment"]
    assert "added" in out["check", "markdown"] and "added" in out["diff", "table"]
    assert app.main(["check", root, "--snapshot", snap, "--format", "json", "--redact", "--salt", "s"]) == 1
    hidden = capsys.readouterr().out
    assert "a.py" not in hidden and "added" not in hidden and len(json.loads(hidden)["entries"]) == len(check["entries"])


def test_churn_from_a_log(project, spark, capsys):
    diff = "diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n@@ -7 +7,2 @@\n+x\n"
    day = 86_400
    log = "".join(f"\0{sha * 40} {at * day}\n\n{diff}" for sha, at in (("a", 1000), ("b", 990), ("c", 800)))
    (project / "log.txt").write_text(log)
    hunks = app.recent_hunks(spark, str(project / "log.txt"), 90, 1001 * day)
    assert sorted((r.commit[0], r.path, r.start, r.end) for r in hunks.collect()) == [("a", "src/a.py", 7, 8), ("b", "src/a.py", 7, 8)]
    assert app.main(["scan", str(project), "--history", str(project / "log.txt"), "--until", str(1001 * day), "--format", "json"]) == 0
    rows = {r["qualname"]: r["commits"] for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert rows["plain"] == 2 and rows["_shown"] == 0


def test_coverage_shards(project, spark):
    half = json.dumps({"files": {"src/a.py": {"executed_lines": [5, 6, 7], "missing_lines": []}}})
    (project / "shard.json").write_text(half)
    (project / "broken.json").write_text("{")
    c = config.parse({"coverage": {"src": "shard.json", "src/a.py": "broken.json", "lib": "none.json"}})
    rows = {r.qualname: r.line_coverage for r in app.analyse(spark, str(project), c).collect()}
    assert rows["plain"] == 1.0


def test_findings_of_an_empty_table(spark):
    none = spark.createDataFrame([], "path string, qualname string, `group` string, kind string, current_score double, previous_score double, delta double, component string, component_delta double, start_line int, end_line int")
    for how in ("table", "json", "markdown", "sarif", "github", "pr-comment"):
        assert isinstance(findings.shown(findings.findings(none), how, "check"), str)
    many = spark.range(2_500).selectExpr("concat('p', id) as path", "'f' as qualname", "'g' as `group`", "'regressed' as kind", "50.0D as current_score", "1.0D as previous_score", "49.0D as delta", "null as component", "null as component_delta", "1 as start_line", "2 as end_line")
    text = findings.comment(findings.findings(many))
    assert "<summary>2480 more</summary>" in text and len(text) <= render.COMMENT_CHARS


def test_comment_counts_rows_that_are_not_shown(spark):
    rows = spark.range(5_030).selectExpr("'low' as severity", "1.0D as score", "'a.py' as path", "concat('f', id) as qualname")
    assert "<summary>5030 more</summary>" in render.comment(rows)


def test_config(tmp_path):
    assert config.parse({"groups": {"g": ["./src/x/"]}}).groups == {"g": ("src/x",)}
    for bad in ({"new_above": -1}, {"churn_days": 0}, {"missing_coverage": "x"}, {"groups": {"g": ["../x"]}}, {"weights": {"zz": 1}}):
        with pytest.raises(config.ConfigError):
            config.parse(bad)
    assert config.parse({"odd": 1}).unknown == ["odd"]


def test_comment_is_cut_at_lines():
    text = "<details>\n" + "\n".join(["x" * 50] * 100) + "\n</details>"
    cut = render.cut_at_lines(text, 1000)
    assert len(cut) <= 1000 and cut.count("<details>") == cut.count("</details>")
