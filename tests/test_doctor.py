import hashlib

from hazardlens.plans import doctor


def test_findings(spark):
    files = spark.createDataFrame([("a/b.py",), ("c.py",)], "path string")
    records = spark.createDataFrame([("/ci/a/b.py", 0)], "record string, ordinal int")
    assert doctor.coverage_overlap(files, records).status == "ok"
    assert doctor.coverage_overlap(files, records.filter("false")).status == "warn"
    assert doctor.may_replace(files.filter("false"), files).status == "fail"
    assert doctor.may_replace(files, files).status == "ok"
    assert doctor.tally([doctor.Finding("x", "ok", ""), doctor.Finding("y", "warn", "")]) == {"ok": 1, "warn": 1, "fail": 0}


def test_rationale():
    assert doctor.explained(False).status == "ok"
    assert doctor.explained(True, "Baseline rationale: short").status == "fail"
    assert doctor.explained(True, "x\nbaseline rationale: a generated parser was replaced").status == "ok"
    assert doctor.explained(True, labels=("baseline-approved",)).status == "ok"


def test_redaction(spark):
    df = spark.createDataFrame([("a.py", "f", 1.0, "moved from a.py::f")], "path string, qualname string, score double, reason string")
    r = doctor.redact(df, "salt").first()
    h = lambda x: hashlib.sha256(("salt" + x).encode()).hexdigest()[:12]
    assert (r.path, r.qualname, r.reason) == (h("a.py"), h("f"), f"moved from {h('a.py')}::{h('f')}")


def test_split_in_half(spark):
    units = spark.createDataFrame([("a", 600), ("b", 3000), ("c", 10)], "path string, n_lines int")
    assert {r.path: r.total_lines for r in doctor.split_in_half(units).collect()} == {"a": 300, "b": 3000, "c": 10}
