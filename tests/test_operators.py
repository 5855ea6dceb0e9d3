import random

import pytest
from pyspark.sql import functions as F

from hazardlens.functions import names, scoring
from hazardlens.operators import churn, coverage, graph, history, ladder, statistics
from hazardlens.sources import lcov, python_files, reports

COMPONENTS = {c: 0.0 for c in scoring.COMPONENTS}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_saturation_and_severity(spark):
    df = spark.createDataFrame([(1.0,), (11.0,), (21.0,), (99.0,)], "v double")
    assert [r[0] for r in df.select(scoring.saturating(F.col("v"), (1.0, 21.0))).collect()] == [0.0, 50.0, 100.0, 100.0]
    s = spark.createDataFrame([(75.0,), (74.9,), (50.0,), (25.0,), (0.0,), (float("nan"),)], "v double")
    assert [r[0] for r in s.select(scoring.severity(F.col("v"))).collect()] == ["critical", "high", "high", "medium", "low", "low"]
    with pytest.raises(ValueError):
        scoring.saturating(F.lit(1), (2.0, 2.0))


def test_weights():
    w = scoring.resolve_weights({"churn": 1.0})
    assert abs(sum(w.values()) - 1) < 1e-12
    for bad in ({"x": 1}, {"churn": -1}, {"churn": float("nan")}, {k: 0 for k in scoring.WEIGHTS}):
        with pytest.raises(ValueError):
            scoring.resolve_weights(bad)


def test_lookups(spark):
    wanted = spark.createDataFrame([("src/foo.py",), ("a.py",)], "path string")
    records = spark.createDataFrame([("/x/long/src/foo.py", 1), ("/x/src/foo.py", 0), ("missing/foo.py", 2)], "record string, ordinal int")
    assert rows(coverage.suffix_lookup(wanted, records)) == [("a.py", None), ("src/foo.py", "/x/src/foo.py")]
    assert ("src/foo.py", "/x/long/src/foo.py") in rows(coverage.suffix_lookup(wanted, records, "longest"))
    groups = spark.createDataFrame([("a", "src"), ("b", "src"), ("any", ".")], "name string, prefix string")
    assert rows(coverage.longest_prefix(wanted, groups)) == [("a.py", "any"), ("src/foo.py", "b")]


def test_overlap_bins_agree(spark):
    rng = random.Random(5)
    units = spark.createDataFrame([(i, rng.choice("ab"), s := rng.randrange(1, 400), s + rng.randrange(150)) for i in range(60)], "unit int, path string, start_line int, end_line int")
    hunks = spark.createDataFrame([(rng.randrange(9), rng.choice("ab"), s := rng.randrange(1, 500), s + rng.randrange(90)) for _ in range(80)], "commit int, path string, start int, end int")
    assert rows(churn.function_churn(units, hunks)) == rows(churn.function_churn(units, hunks, 64))


def snapshot(spark, data):
    cols = "path string, qualname string, ordinal long, score double, fingerprint string, signature string, group string, language string"
    df = spark.createDataFrame([(*r, None, "python") for r in data], cols)
    return df.withColumns({c: F.lit(0.0) for c in scoring.COMPONENTS})


def test_ladder(spark):
    old = snapshot(spark, [("a.py", "f", 0, 10.0, "x", "s"), ("a.py", "g", 1, 20.0, "y", "s"), ("b.py", "h", 2, 30.0, "z", "t"), ("c.py", "h", 3, 30.0, "z", "t"), ("d.py", "gone", 4, 1.0, "q", "q")])
    new = snapshot(spark, [("a.py", "f", 0, 16.0, "x2", "s"), ("n.py", "g", 1, 20.0, "y", "s"), ("m.py", "h", 2, 30.0, "z", "t"), ("z.py", "new", 3, 60.0, "w", "w")])
    got = {(r.path, r.qualname): r.status for r in ladder.diff(new, old).collect()}
    assert got == {("a.py", "f"): "regressed", ("n.py", "g"): "moved", ("m.py", "h"): "ambiguous_rename", ("z.py", "new"): "new", ("d.py", "gone"): "removed", ("b.py", "h"): "removed", ("c.py", "h"): "removed"}
    kinds = {(r.path, r.qualname): r.kind for r in ladder.regressions(ladder.diff(new, old)).collect()}
    assert kinds == {("a.py", "f"): "regressed", ("m.py", "h"): "new_above_threshold", ("z.py", "new"): "new_above_threshold"}


def test_delta_at_tolerance_is_no_regression(spark):
    old, new = snapshot(spark, [("a", "f", 0, 10.0, None, None)]), snapshot(spark, [("a", "f", 0, 15.0, None, None)])
    assert [r.status for r in ladder.diff(new, old).collect()] == ["unchanged"]


def test_renames_against_plain_python(spark):
    rng = random.Random(11)
    make = lambda n, side: [(f"{rng.choice('pq')}{side}.py", f"k.{rng.choice('fgh')}{i}", i, float(rng.randrange(0, 9)), rng.choice(["x", "y", "z", None]), rng.choice("st")) for i in range(n)]
    o, n = make(12, "o"), make(12, "n")
    got = {(r.path, r.qualname): (r.old_path, r.old_qualname, r.ambiguous) for r in ladder.renames(snapshot(spark, n), snapshot(spark, o)).collect()}
    unique = lambda side, fp: sum(r[4] == fp for r in side) == 1
    taken = {r[4] for r in n if r[4] and unique(n, r[4]) and unique(o, r[4])}
    used, want = set(), {}
    for p, q, _, s, fp, sig in n:
        if fp is None or fp in taken:
            continue
        scores = []
        for p2, q2, _, s2, fp2, sig2 in o:
            if fp2 == fp and (p2, q2) not in used:
                v = 0.55 + 0.2 * (sig == sig2) + 0.1 * (p == p2) + 0.05 * (q.split(".")[-1] == q2.split(".")[-1]) + 0.05 + 0.05 * (abs(s - s2) <= 2)
                scores.append((round(v, 6), p2, q2))
        scores.sort(key=lambda x: (-x[0], f"{x[1]}::{x[2]}"))
        if scores and scores[0][0] >= 0.65:
            near = [x for x in scores if scores[0][0] - x[0] <= 0.05]
            if len(near) > 1:
                want[p, q] = (None, None, True)
            else:
                used.add(near[0][1:])
                want[p, q] = (*near[0][1:], False)
    assert got == want


def test_statistics_known_answers(spark):
    df = spark.createDataFrame([(10.0, True), (11.0, True), (12.0, True), (1.0, False), (2.0, False), (3.0, False)], "v double, p boolean")
    r = statistics.mann_whitney(df, "v", "p").first()
    assert (r.u, r.effect, r.auc) == (9.0, 1.0, 1.0)
    assert statistics.mann_whitney(df.filter("p"), "v", "p").first().effect is None
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert statistics.pearson(flat, "x", "y").first()[0] is None
    d = statistics.distribution(spark.createDataFrame([(0.0,), (0.0,), (10.0,), (20.0,), (95.0,)], "v double"), "v").first()
    assert (d.n, d.zeros, d.bin9, d.median) == (5, 0.4, 1, 10.0)
    assert statistics.sign_test(10, 24) == pytest.approx(0.0243, abs=1e-4)


def test_reachability_with_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "a int, b int")
    assert rows(graph.reachable(e, spark.createDataFrame([(1,)], "node int"))) == [(1,), (2,), (3,)]


def test_export_graph(spark):
    ex = "file string, export_name string, kind string, local_name string, specifier string, source_name string"
    exports = spark.createDataFrame([
        ("index.ts", "shown", "forward", None, "./lib/a.js", "inner"), ("index.ts", None, "star", None, "./b", None),
        ("lib/a.ts", "inner", "local", "innerImpl", None, None), ("b.ts", "default", "local", "d", None, None), ("b.ts", "extra", "local", "extra", None, None),
    ], ex)
    files = spark.createDataFrame([("index.ts",), ("lib/a.ts",), ("b.ts",)], "file string")
    reached, lost, poisoned = graph.public_names(exports, spark.createDataFrame([("index.ts",)], "file string"), files)
    assert rows(reached) == [("b.ts", "extra"), ("lib/a.ts", "innerImpl")] and rows(lost) == [] and not poisoned


def test_export_graph_has_no_cap(spark, monkeypatch):
    depths = []
    whole = graph.reachable
    monkeypatch.setattr(graph, "reachable", lambda edges, roots, depth=None: (depths.append(depth), whole(edges, roots, depth))[1])
    ex = "file string, export_name string, kind string, local_name string, specifier string, source_name string"
    exports = spark.createDataFrame([("a.ts", "f", "local", "f", None, None)], ex)
    files = spark.createDataFrame([("a.ts",)], "file string")
    assert rows(graph.public_names(exports, files, files)[0]) == [("a.ts", "f")] and depths == [None, None]


def test_history(spark):
    log = spark.createDataFrame([("a\0p\0fix: crash #12",), ("b\0p q\0bugfix",), ("c\0p\0add prefix",), ("bad",)], "line string")
    assert sorted((r.sha, r.is_merge) for r in history.fix_commits(log).collect()) == [("a", False), ("b", True)]


def test_sources(spark):
    texts = spark.createDataFrame([("r", '{"files": {"a\\\\b.py": {"executed_lines": [1, 2], "missing_lines": [3], "executed_branches": [[1, 2], [3]]}, "bad": 3}}')], "report string, text string")
    f = reports.coverage_files(texts)
    assert [r.path for r in f.collect()] == ["a/b.py"]
    assert reports.coverage_lines(f).count() == 3 and reports.coverage_arcs(f).count() == 1
    diff = "+++ b/x.py\n@@ -1 +2,3 @@\n@@ -5,2 +7,0 @@\n+++ /dev/null\n@@ -1 +0,0 @@"
    h = reports.hunks(spark.createDataFrame([("c", diff)], "commit string, text string"))
    assert rows(h.select("path", "start", "end")) == [("x.py", 2, 4), ("x.py", 7, 7)]
    assert reports.hunks(spark.createDataFrame([("c", diff)], "commit string, text string"), keep_empty=False).count() == 1
    bad = spark.createDataFrame([("r", '{"version": "9", "entries": []}')], "report string, text string")
    with pytest.raises(Exception, match="unreadable baseline"):
        reports.baseline_entries(bad).collect()
    i = spark.createDataFrame([(0, '{"a.ts": {"statementMap": {"0": {"start": {"line": 4}}}, "s": {"0": 7}, "branchMap": {}, "b": {}}}')], "ordinal int, text string")
    assert rows(reports.istanbul(i)[0]) == [("a.ts", 4, 7)]
    text = "SF:a.ts\nDA:1,2\nBRDA:1,0,0,-\nBRDA:1,0,1,3\nend_of_record\n"
    r = lcov.records(spark.createDataFrame([("l", text)], "report string, text string"))
    assert rows(lcov.statements(r)) == [("a.ts", 1, 2)] and [x.arms for x in lcov.branches(r).collect()] == [[0, 3]]


def test_python_parser(spark):
    files = spark.createDataFrame([("a.py", python_files.EXAMPLE.encode()), ("bad.py", b"def (")], "path string, content binary")
    p = python_files.parsed(files).cache()
    got = {r.qualname: (r.is_public, r.cyclomatic) for r in python_files.functions(p).collect()}
    assert got == {"plain": (True, 5), "_shown": (True, 1), "Thing.value": (True, 1), "Thing._hidden": (False, 1), "Thing._hidden.inner": (False, 1)}
    assert [r.path for r in python_files.errors(p).collect()] == ["bad.py"]


def test_names(spark):
    df = spark.createDataFrame([("a._b",), ("a.__init__",), ("____",), ("ok.f",)], "q string")
    assert [r[0] for r in df.select(names.is_public(F.col("q"))).collect()] == [False, True, False, True]
    p = spark.createDataFrame([("src/a/b.py",), ("lib/c.py",)], "p string")
    assert [r[0] for r in p.select(names.any_glob(F.col("p"), ["src/*.py"])).collect()] == [True, False]


def test_first_enclosing_of_points_in_any_order(spark):
    units = spark.createDataFrame([(i, "a", 10 * i, 10 * i + 9, i) for i in range(50)] + [(99, "a", 0, 39, -1)], "unit int, path string, start_line int, end_line int, ordinal int")
    shuffled = lambda batches: (b.sample(frac=1) for b in batches)
    points = spark.range(0, 600, 1, 4).selectExpr("'a' as path", "cast(id as int) as line").mapInPandas(shuffled, "path string, line int")
    got = {r.line: r.unit for r in coverage.first_enclosing(units, points).collect()}
    assert got == {i: 99 if i < 40 else i // 10 if i < 500 else None for i in range(600)}
    twice = spark.createDataFrame([("a", 45), ("a", 45), (None, 45), ("a", None)], "path string, line int")
    assert sorted(r.unit or -1 for r in coverage.first_enclosing(units, twice).collect()) == [-1, -1, 4, 4]
