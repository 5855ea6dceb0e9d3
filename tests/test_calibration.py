import json
import random

from pyspark.sql import functions as F

from hazardlens.functions import names
from hazardlens.functions.scoring import COMPONENTS
from hazardlens.operators import calibration, coverage, history, report
from hazardlens.sources import python_files


def test_salt_precedence():
    env = {"HAZARDLENS_SALT": "e"}
    assert [calibration.salt(*x) for x in (("f", env, "c", "s"), (None, env, "c", "s"), (None, {}, "c", "s"), ("", {}, "", "s"), (None, {}, None, None))] == ["f", "e", "c", "s", None]


def test_payload_sorts_rounds_and_drops_nan(spark):
    rows = spark.createDataFrame([("b", 0.123456, 2), ("a", float("nan"), None)], "k string, x double, n int")
    assert json.loads(calibration.payload(rows, ["k"])) == [{"k": "a", "n": None, "x": None}, {"k": "b", "n": 2, "x": 0.1235}]


def test_empty_statistics(spark):
    none = spark.createDataFrame([], "repo string, auc double, n long, v double, y boolean")
    assert calibration.mean_median(none, "v").first().asDict() == {"n": 0, "mean": None, "median": None}
    assert calibration.mean_auc(none).first().asDict() == {"mean_auc": None, "weighted_auc": None}
    assert calibration.paired(none, none).first().asDict() == {"groups": 0, "mean_delta": None, "wins": 0, "decided": 0}
    got = calibration.tier_gradient(none.withColumn("tier", F.lit("low")), "tier", "v", ["low", "high"]).collect()
    assert sorted((r.tier, r.n, r.mean) for r in got) == [("high", 0, None), ("low", 0, None)]


def test_paired_takes_groups_scored_in_both(spark):
    a = spark.createDataFrame([("x", 0.9), ("y", 0.5), ("z", 0.7), ("w", None)], "repo string, auc double")
    b = spark.createDataFrame([("x", 0.8), ("y", 0.5), ("w", 0.1)], "repo string, auc double")
    r = calibration.paired(a, b).first()
    assert (r.groups, round(r.mean_delta, 6), r.wins, r.decided) == (2, 0.05, 1, 1)


def test_tracking_prefers_the_same_path_of_two_equal_bodies(spark):
    zero = [0.0] * (len(COMPONENTS) + 1)
    schema = "sid string, path string, qualname string, fingerprint string, signature string, score double, " + ", ".join(f"{c} double" for c in COMPONENTS)
    old = [("1", "a.py", "f", "b1", "s1"), ("2", "b.py", "g", "b1", "s1"), ("3", "c.py", "h", "b2", "s2"), ("4", "c.py", "k", "b2", "s3"), ("5", "d.py", "C.m", None, "s9")]
    snapshot = spark.createDataFrame([(*r, *zero) for r in old], schema)
    rows = spark.createDataFrame([("a.py", "f2", "b1", "s1"), ("z.py", "z", "b2", "s8"), ("c.py", "k", "other", None), ("y.py", "q", "b2", "s2"), ("d.py", "D.m", None, "s9"), ("n.py", "n", "b7", "s7")], "path string, qualname string, fingerprint string, signature string")
    got = {r.path + r.qualname: r.sid for r in history.tracked(rows, snapshot).collect()}
    # equal bodies: the same path decides; two as near as each other are ambiguous; without a body it stays below the bound
    assert got == {"a.pyf2": "1", "z.pyz": None, "c.pyk": "4", "y.pyq": "3", "d.pyD.m": None, "n.pyn": None}


def test_tracking_agrees_with_all_pairs(spark):
    rng = random.Random(3)
    pick = lambda *xs: rng.choice(xs)
    zero = [c for c in COMPONENTS if c != "churn"]
    old = [(i, pick("a", "b", "c", None), f"m{i}.{pick('f', 'g', 'h')}", pick("b1", "b2", "b3", "b4", f"u{i}"), pick("s1", "s2", None), pick(0.0, 0.0, 3.0), pick(1.0, 50.0)) for i in range(40)]
    new = sorted({(pick("a", "b", "c", "d"), f"n{i}.{pick('f', 'g', 'k')}", pick("b1", "b2", "b3", "b4", *[f"u{j}" for j in range(40)]), pick("s1", "s2", "s3")) for i in range(150)})
    snapshot = spark.createDataFrame(old, "sid int, path string, qualname string, fingerprint string, signature string, churn double, score double").withColumns({c: F.lit(0.0) for c in zero})
    rows = spark.createDataFrame(new, "path string, qualname string, fingerprint string, signature string")
    want = {}
    for path, name, body, sig in new:
        like = lambda o: round(0.55 * (o[3] == body) + 0.2 * (o[4] == sig) + 0.1 * (o[1] == path) + 0.05 * (o[2].split(".")[-1] == name.split(".")[-1]) + 0.05 * (o[5] == 0) + 0.05 * (o[6] <= 2), 6)  # noqa: B023, E731
        best = max(map(like, old))
        near = [o[0] for o in old if best - like(o) <= 0.05]
        want[path, name] = near[0] if best >= 0.65 and len(near) == 1 else None
    assert {(r.path, r.qualname): r.sid for r in history.tracked(rows, snapshot).collect()} == want and len(set(want.values())) > 5


def test_tracking_pairs_no_copies(spark):
    zero = {c: F.lit(0.0) for c in (*COMPONENTS, "score")}
    ids = lambda name: ("'p' as path", f"concat('{name}', id) as qualname", "concat('body', if(id < 1500, 0, id)) as fingerprint", "'s' as signature")
    rows, snapshot = spark.range(3000).selectExpr(*ids("n.n")), spark.range(3000).selectExpr("id as sid", *ids("o.o")).withColumns(zero)
    out = history.tracked(rows, snapshot)
    assert out.filter("sid is not null").count() == 1500
    out.collect()
    assert max(rows_made(out)) < 100_000


def rows_made(df):
    seen, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
        rows = node.metrics().get("numOutputRows")
        if rows.isDefined():
            seen.append(rows.get().value())
    return seen


def test_gate_rollup_falls_back_to_the_diff(spark):
    diff = spark.createDataFrame([("g", "improved"), (None, "new")], "group string, status string")
    reg = spark.createDataFrame([("p", "q", "g", "regressed", 9.0, 0.0), ("p", "a", "g", "regressed", 9.0, None), ("p", "b", None, "component_regressed", 1.0, 20.0)], "path string, qualname string, group string, kind string, current_score double, delta double")
    assert "improved" in report.gate_rollup(reg.filter("false"), diff).columns
    got = {r["group"]: (r.regressed, r.component_regressed) for r in report.gate_rollup(reg, diff).collect()}
    assert got == {"g": (2, 0), "ungrouped": (0, 1), None: (2, 1)}
    assert [r.qualname for r in report.regression_order(reg).collect()] == ["b", "a", "q"]


def test_module_exports_only():
    nested = "__all__ = ['_a']\ndef _a():\n    return 1\ndef f():\n    __all__ = []\n    return __all__\n"
    rows = {r["qualname"]: r for r in python_files.parse("m.py", nested.encode()) if r.get("qualname")}
    assert rows["_a"]["is_public"] and rows["f"]["is_public"]


def test_names(spark):
    row = spark.createDataFrame([("git@h.example:o/n.git", "https://h.example/o/n/", "== 3 failed, 2 passed", "ok", "a.pb.mts", "// @generated", "see @generated", "src/__tests__/a.ts")], "a string, b string, c string, d string, e string, f string, g string, h string")
    got = row.select(
        names.repo_slug(F.col("a")), names.repo_slug(F.col("b")), names.n_failed(F.col("c")), names.n_failed(F.col("d")), names.generated(F.col("e"), F.lit("")), names.generated(F.lit("a.ts"), F.col("f")),
        names.generated(F.lit("a.ts"), F.col("g")), names.product_file(F.col("h")), names.product_file(F.lit("src/a.ts")),
    ).first()
    assert list(got) == ["o/n", "o/n", 3, 0, True, True, False, False, True]


def test_suffix_lookup(spark):
    wanted = spark.createDataFrame([("src/a.py",), ("a.py",), ("b.py",), ("x/a.py",)], "path string")
    records = spark.createDataFrame([("/r/src/a.py", 2), ("/q/w/src/a.py", 1), ("src/a.py", 3), ("xa.py", 0)], "record string, ordinal int")
    first = {r.path: r.record for r in coverage.suffix_lookup(wanted, records).collect()}
    assert first == {"src/a.py": "src/a.py", "a.py": "/q/w/src/a.py", "b.py": None, "x/a.py": None}
    assert {r.path: r.record for r in coverage.suffix_lookup(wanted, records, "longest").collect()}["a.py"] == "/q/w/src/a.py"
