"""Audit history, JSON documents and the audit report."""

import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from strata.model import Config, Layer, Override, Rule
from strata.plans.check import audit
from strata.sources.exports import json_documents
from strata.sources.history_store import HistoryStore

AUDIT = "project_id string, run_date date, ts timestamp, violations int"


def snapshot(project, day, hour, n):
    return (project, date(2024, 1, day), datetime(2024, 1, day, hour), n)


@pytest.fixture
def store(spark, tmp_path):
    return HistoryStore(spark, str(tmp_path / "audits"))


def held(store):
    return {(r.project_id, r.run_date.day): r.violations for r in store.load().collect()}


def files(store):
    return {os.path.join(top, n) for top, _, names in os.walk(store.path) for n in names if n.endswith(".parquet")}


def test_a_save_leaves_other_rows_alone(spark, store):
    store.save(spark.createDataFrame([snapshot("p", 1, 8, 5), snapshot("q", 1, 8, 7)], AUDIT))
    before = files(store)
    # the last save wins, and within a save the newest time
    store.save(spark.createDataFrame([snapshot("p", 1, 7, 6), snapshot("p", 1, 6, 9)], AUDIT))
    assert before < files(store) and held(store) == {("p", 1): 6, ("q", 1): 7}
    store.compact()
    assert held(store) == {("p", 1): 6, ("q", 1): 7} and store._log().count() == 2


def test_delete_old(spark, store):
    store.save(spark.createDataFrame([snapshot("p", d, 8, d) for d in range(1, 16)] + [snapshot("q", d, 8, d) for d in (1, 9)], AUDIT))
    store.save(spark.createDataFrame([snapshot("p", 3, 9, 33), snapshot("p", 12, 9, 120)], AUDIT))
    kept = {f for f in files(store) if "2024-01-14" in f}
    assert store.delete_old(10) == 5
    want = {("p", d): d for d in range(6, 16)} | {("q", 1): 1, ("q", 9): 9, ("p", 12): 120}
    assert held(store) == want
    assert kept <= files(store) and not os.path.exists(f"{store.path}/run_date=2024-01-02")
    assert store.delete_old(10) == 0 and held(store) == want
    store.save(spark.createDataFrame([snapshot("p", 2, 8, 2)], AUDIT))
    assert store.delete_old(1) == 11 and held(store) == {("p", 15): 15, ("q", 9): 9}


VIOLATION = (
    "project_id string, id string, rule_id string, severity string, file string, line int, source_layer string, target_layer string, "
    "import_path string, message string, overridden boolean"
)


def test_one_document_per_project(spark, tmp_path):
    rows = [("hot/one", f"V-{i}", "r", ["error", "warning", "odd"][i % 3], f"f{i % 50:02d}", i, "a", "b", 'x"\\\n', "m é", i % 7 == 0) for i in range(3000)]
    rows += [("b", "V-1", "r", "info", "f", 1, "a", "b", None, "m", None)]
    df = spark.createDataFrame(rows, VIOLATION).repartition(6)
    projects = spark.createDataFrame([("hot/one",), ("b",), ("clean",), ("clean",)], "project_id string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out, work = f"file://{tmp_path}/out", f"file://{tmp_path}/work"
        written = {r.project_id: r for r in json_documents(df, projects, out, work).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert set(written) == {"hot/one", "b", "clean"} and sorted(os.listdir(tmp_path / "out")) == ["b.json", "clean.json", "hot%2Fone.json"]
    # the hot project was written by more than one task
    assert len(os.listdir(tmp_path / "work")) > 2
    found = {}
    for project, row in written.items():
        with open(row.file, encoding="utf-8") as f:
            text = f.read()
        assert row.bytes == len(text.encode())
        found[project] = json.loads(text)
    hot = found["hot/one"]
    want = sorted((r[1:] for r in rows if r[0] == "hot/one"), key=lambda r: (r[3], r[4], r[0]))
    assert [(v["id"], v["file"], v["line"], v["import"], v["message"], v.get("overridden", False)) for v in hot["violations"]] == [
        (r[0], r[3], r[4], r[7], r[8], r[9]) for r in want
    ]
    assert hot["summary"] == {"total": 3000, "errors": 2000, "warnings": 1000, "info": 0, "overridden_count": 429}
    assert found["clean"] == {"schema_version": "1.0", "violations": [], "summary": {"total": 0, "errors": 0, "warnings": 0, "info": 0, "overridden_count": 0}}
    assert len(found["b"]["violations"]) == 1


def test_audit_with_an_expression_rule_and_an_exclude(spark, rows):
    layers = (Layer("a", ("a/**",)), Layer("b", ("b/**",)))
    deps = spark.createDataFrame(
        [("p", "a/x", 1, "b/y", "b", "go"), ("p", "a/gen/z", 1, "b/y", "b", "go"), ("p", "b/gen/q", 1, "a/y", "a", "go")],
        "project_id string, source_file string, source_line int, import_path string, resolved_layer string, language string",
    )
    rule = Rule("r", "a", ("b",), overrides=(Override("a/none", "info"),))
    config = Config(layers, (rule, Rule("few", check="count > 5")), ("gen",))
    projects = spark.createDataFrame([("p",)], "project_id string")
    with pytest.raises(ValueError):
        audit(deps, config, projects)
    metrics = spark.createDataFrame([("p", 1)], "project_id string, n int")
    report = audit(deps, config, projects, metrics, [(2, "few", F.col("n") <= 5, "error", "too few")])
    assert rows(report["violations"], "rule_id", "file") == [("few", ""), ("r", "a/x")]
    # the excluded files are nowhere: one edge, no pair both ways
    assert rows(report["coupling"], "from_layer", "to_layer", "cnt") == [("a", "b", 1)]
    assert report["debt"].first().project_id == "p" and report["gate"].first().counted == 2
