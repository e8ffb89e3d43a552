"""Diffs, baselines, history, expectations, ordered scans."""

import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strata.operators import diffs, guidance, history
from strata.operators.expectations import Expectation, expect_suite, suite_passed
from strata.operators.ordered import running, set_digest
from strata.operators.scoring import gate, project_report, severity_counts, violation_density, workspace_report

V = "project_id string, rule_id string, source_layer string, target_layer string, import_path string, file string, line int, id string"


def viol(spark, rows_):
    return spark.createDataFrame([("p", r, "a", "b", i, f, n, f"{r}{i}{f}{n}") for r, i, f, n in rows_], V)


def random_rows(rng, n):
    return [(f"r{rng.randint(1, 3)}", f"i{rng.randint(1, 4)}", f"f{rng.randint(1, 3)}", rng.randint(1, 9)) for _ in range(n)]


def test_diff_symmetry_and_last_wins(spark, rows):
    rng = random.Random(1)
    a, b = viol(spark, random_rows(rng, 12)), viol(spark, random_rows(rng, 12))
    ab, ba = diffs.diff_runs(a, b, ["line", "file"]), diffs.diff_runs(b, a, ["line", "file"])
    added = rows(ab.where("change = 'added'"), *diffs.KEYS)
    assert added == rows(ba.where("change = 'resolved'"), *diffs.KEYS)
    one = diffs.diff_runs(viol(spark, []), viol(spark, [("r", "i", "f", 1), ("r", "i", "g", 5)]), ["line"])
    assert rows(one, "file", "change") == [("g", "added")]


def test_watch_diff_keeps_duplicates_and_ignores_moves(spark, rows):
    old = viol(spark, [("r", "i", "f", 1), ("r", "j", "f", 2), ("r", "j", "g", 2)])
    new = viol(spark, [("r", "i", "moved", 9), ("s", "k", "f", 1), ("s", "k", "g", 1)])
    assert rows(diffs.watch_diff(old, new), "file", "change") == [
        ("f", "added"), ("f", "resolved"), ("g", "added"), ("g", "resolved"), ("moved", "unchanged"),
    ]
    summary = diffs.change_summary(diffs.watch_diff(old, new), ["project_id"]).first()
    assert (summary.added, summary.resolved, summary.unchanged, summary.has_changes) == (2, 2, 1, True)
    assert summary.summary == "+2 violations, -2 resolved, 1 unchanged"


def test_baseline(spark, rows):
    known = viol(spark, [("r", "i", "f", 1)])
    now = viol(spark, [("r", "i", "other", 9), ("r", "i", "f", 1), ("s", "i", "f", 1)])
    base = diffs.baseline_generate(known, F.lit("h1"), F.lit(datetime(2024, 1, 1)))
    fresh = diffs.baseline_filter(now, base)
    assert rows(fresh, "rule_id") == [("s",)]
    assert rows(diffs.baseline_filter(fresh, base), "rule_id") == [("s",)]
    assert diffs.baseline_filter(now, None).count() == 3
    assert diffs.suppressed_count(now, base).first().suppressed == 2
    projects = spark.createDataFrame([("p", "h1"), ("q", "h1")], "project_id string, config_hash string")
    assert rows(diffs.baseline_stale(projects, base)) == [("p", False), ("q", True)]


def test_pr_filter_modes(spark, rows):
    found = viol(spark, [("r", "i", "edited", 2), ("r", "i", "edited", 5), ("r", "i", "gone", 1), ("r", "i", "new", 1)])
    lines = spark.createDataFrame(
        [
            ("p", 1, "edited", 0, 2), ("p", 1, "edited", 3, 0), ("p", 1, "edited", 4, 5), ("p", 1, "gone", 1, 0), ("p", 1, "new", 0, 1),
            ("p", 2, "edited", 1, 0), ("p", 2, "new", 0, 1), ("p", 3, "gone", 0, 1),
        ],
        "project_id string, pr int, file string, old_line int, new_line int",
    )
    judged = diffs.pr_filter(found, lines)
    # change 2 deletes what change 1 edits, and change 3 adds what change 1 deletes
    assert rows(judged, "pr", "file", "line") == [(1, "edited", 2), (1, "new", 1), (2, "new", 1), (3, "gone", 1)]
    assert rows(diffs.pr_filter(found, lines, compat=True), "pr", "file") == [(1, "new"), (2, "new"), (3, "gone")]
    changes = spark.createDataFrame([("p", 1), ("p", 2), ("p", 4)], "project_id string, pr int")
    totals = rows(diffs.pr_summary(judged, found, changes), "pr", "n_new", "n_total", "passed")
    assert totals == [(1, 2, 4, False), (2, 1, 4, False), (4, 0, 4, True)]


def test_conflicts_match_brute_force(spark):
    rng = random.Random(9)
    spans = [("p", f"f{rng.randint(1, 2)}", rng.randint(1, 300), rng.randint(0, 90), f"v{i:03d}") for i in range(90)]
    data = [(p, f, i, s, s + n) for p, f, s, n, i in spans] + [("p", "f1", f"w{i}", 7, 7) for i in range(5)]
    df = spark.createDataFrame(data, "project_id string, file string, violation_id string, start_line int, end_line int")
    want = sum(
        1
        for i, a in enumerate(data)
        for b in data[i + 1 :]
        if a[1] == b[1] and a[3] - 3 <= b[4] + 3 and b[3] - 3 <= a[4] + 3
    )
    assert diffs.fix_conflicts(df).agg(F.sum("n_pairs")).first()[0] == want


def test_hunk_ranges(spark, rows):
    df = spark.createDataFrame([("@@ -1,2 +10,3 @@",), ("@@ -1 +4 @@",), ("junk",)], "diff string")
    assert rows(guidance.parse_hunk_range(df), "start_line", "end_line") == [(0, 0), (4, 4), (10, 12)]


def test_running_matches_plain_window(spark):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randint(1, 5)}", i, rng.randint(0, 3)) for i in range(500)]
    df = spark.createDataFrame(data, "k string, o int, v int")
    got = running(df, ["k"], ["o"], {"total": F.col("v")}, {"seen": F.when(F.col("v") == 3, F.col("o"))}, "n")
    state, want = {}, {}
    for k, o, v in sorted(data, key=lambda x: x[1]):
        total, seen, n = state.get(k, (0, None, 0))
        state[k] = (total + v, o if v == 3 else seen, n + 1)
        want[o] = state[k]
    assert {r.o: (r.total, r.seen, r.n) for r in got.collect()} == want


def test_set_digest(spark):
    """One formula for every size: order is nothing, copies count, removing what was added restores it."""
    base = [("p", x) for x in "abcaxyz"]
    digest = lambda rows: dict(set_digest(spark.createDataFrame(rows, "k string, x string"), ["k"], "x").collect())["p"]
    first = digest(base)
    assert digest(base[::-1]) == first and digest([*base, ("p", "a")]) != first and digest(base[:-1]) != first
    many = [("p", f"item{i}") for i in range(3000)]
    assert digest([*many, ("p", "z")]) != digest(many) == digest(many[::-1])
    words = [0] * 16
    for _, x in base:
        h = hashlib.sha256(x.encode()).hexdigest()
        words = [w + int(h[4 * i : 4 * i + 4], 16) for i, w in enumerate(words)]
    assert first == hashlib.sha256(":".join(map(str, [len(base), *words])).encode()).hexdigest()


def test_trends(spark):
    day = datetime(2024, 1, 1)
    series = [(5, 9), (4, 12), (4, 12), (6, 12), (6, 13)]
    audits = spark.createDataFrame(
        [("p", (day + timedelta(i)).date(), v, dbt) for i, (v, dbt) in enumerate(series)],
        "project_id string, run_date date, violations int, debt int",
    )
    got = [r.status for r in history.trend_report(audits).orderBy("run_date").collect()]
    assert got == ["unchanged", "improved", "unchanged", "degraded", "degraded"]
    trend = [r.trend for r in history.debt_trend(audits).orderBy("run_date").collect()]
    assert trend == ["stable", "up", "stable", "stable", "up"]
    assert history.retention(audits, 2).where("kept").count() == 2
    assert history.since_filter(audits, "2024-01-04").count() == 2


def test_clean_streak(spark):
    base = datetime(2024, 1, 1)
    dirty = [0, 0, 1, 0, 0, 0, 0, 1, 0]
    runs = spark.createDataFrame(
        [("p", base + timedelta(hours=i), v) for i, v in enumerate(dirty)], "project_id string, ts timestamp, violations int"
    )
    out = history.clean_streak(runs, 3).orderBy("ts").collect()
    assert [r.streak for r in out] == [1, 2, 0, 1, 2, 0, 1, 0, 1]
    assert [r.refresh for r in out] == [False] * 5 + [True] + [False] * 3
    loose = history.clean_streak(runs, 3, compat=True).orderBy("ts").collect()
    assert [i for i, r in enumerate(loose) if r.refresh] == [2, 5, 8]


def test_daily_upsert_latest_ttl(spark):
    at = datetime(2024, 1, 1, 8)
    df = spark.createDataFrame(
        [("p", at.date(), at, 1), ("p", at.date(), at + timedelta(hours=2), 2), ("p", (at + timedelta(1)).date(), at + timedelta(1), 3)],
        "project_id string, run_date date, ts timestamp, violations int",
    )
    assert sorted(r.violations for r in history.daily_upsert(df).collect()) == [2, 3]
    assert history.latest_snapshot(df).first().violations == 3
    now = F.lit(at + timedelta(hours=25))
    assert sorted(r.violations for r in history.ttl_filter(df, now).collect()) == [2, 3]


def test_expectations(spark):
    found = viol(spark, [("r", "i", "src/a/x.go", 1), ("s", "i", "lib/y.go", 2)]).withColumn("message", F.lit("no way"))
    cases = [
        Expectation("good", "r", 1, ("src/**",), (("a", "b"),), ("^no",)),
        Expectation("bad", "r", 2, ("nope/*",)),
        Expectation("broken regex", patterns=("([",)),
    ]
    got = {r.case_name: (r.passed, r.details) for r in expect_suite(found, cases).collect()}
    assert got["good"] == (True, "all expectations met")
    assert got["bad"] == (False, "expected 2 violations, got 1; no violations matched any file pattern")
    assert got["broken regex"][0] is False
    assert suite_passed(expect_suite(found, [])).first().passed is False


def test_scores(spark):
    df = spark.createDataFrame(
        [("p", "error", False), ("p", "odd", False), ("p", "warning", True), ("p", "info", False)],
        "project_id string, severity string, overridden boolean",
    )
    projects = spark.createDataFrame([("p",), ("clean",)], "project_id string")
    counts = severity_counts(df, ["project_id"]).first()
    assert (counts.total, counts.errors, counts.warnings, counts.info) == (4, 2, 1, 1)
    assert {r.project_id: r.passed for r in gate(df, projects).collect()} == {"p": False, "clean": True}
    assert {r.project_id: r.passed for r in gate(df, projects, 3).collect()} == {"p": True, "clean": True}
    reports = project_report(df, projects)
    fleet = workspace_report(reports).first()
    assert (fleet.total_projects, fleet.failed_projects, fleet.total_violations, fleet.passed) == (2, 1, 4, False)
    broken = projects.withColumn("error", F.when(F.col("project_id") == "clean", "boom").otherwise(""))
    assert workspace_report(project_report(df, broken)).first().failed_projects == 2
    dens = spark.createDataFrame([(3, 1500), (3, 0)], "violations int, lines int")
    assert [r.density for r in violation_density(dens).collect()] == [2.0, 0.0]


def test_patterns_are_judged_by_the_engine_that_runs_them(spark):
    from strata.operators.expectations import engine_pattern

    assert engine_pattern("(?P<layer>a+)b") == "(?<layer>a+)b" and engine_pattern("a[") is None
    assert engine_pattern("\\p{Lu}x") == "\\p{Lu}x"
