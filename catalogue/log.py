"""Queries over the violation log: diffs, history, expectations, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.base import block, digest_sql, query
from strata.operators import diffs, guidance, history, scoring
from strata.operators.expectations import (
    Expectation,
    expect_count,
    expect_files,
    expect_layers,
    expect_patterns,
    expect_suite,
    suite_passed,
)
from strata.plans.check import compare_refs
from strata.sources import exports
from strata.sources.adapters import changes_from_events, violations_from_events
from strata.streaming import watch

# --- fixed values: the day that splits "before" from "after" -------------------
SPLIT = "2024-01-16"
# --------------------------------------------------------------------------------

block(
    "e_viol",
    """
SELECT 'p' || (user_id % 7) AS project_id, ts, CAST(ts AS DATE) AS run_date, 'E-' || event_id AS id,
       'rule-' || event_type AS rule_id, 'src/u' || user_id || '.py' AS file, k AS line,
       ['domain', 'application', 'infrastructure', 'presentation'][user_id % 4 + 1] AS source_layer,
       ['domain', 'application', 'infrastructure', 'presentation'][k % 4 + 1] AS target_layer,
       'mod/m' || (k % 20) AS import_path, event_type || ' at ' || k AS message,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity,
       value > 400 AS overridden, sha256('cfg' || (day(ts) // 10)) AS config_hash
FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)
""",
)
block("e_old", f"SELECT * FROM e_viol WHERE run_date < DATE '{SPLIT}'")
block("e_new", f"SELECT * FROM e_viol WHERE run_date >= DATE '{SPLIT}'")
KEYS = "project_id, rule_id, source_layer, target_layer, import_path"
block(
    "e_diff",
    f"""
SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.rule_id, b.rule_id) AS rule_id,
       coalesce(a.source_layer, b.source_layer) AS source_layer, coalesce(a.target_layer, b.target_layer) AS target_layer,
       coalesce(a.import_path, b.import_path) AS import_path, coalesce(b.id, a.id) AS id, coalesce(b.file, a.file) AS file,
       CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'resolved' ELSE 'unchanged' END AS change
FROM (SELECT * FROM e_old QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY ts DESC, id DESC) = 1) a
FULL JOIN (SELECT * FROM e_new QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY ts DESC, id DESC) = 1) b
USING ({KEYS})
""",
)
block(
    "e_watch",
    f"""
SELECT n.project_id, n.id, CASE WHEN k.project_id IS NULL THEN 'added' ELSE 'unchanged' END AS change
FROM e_new n LEFT JOIN (SELECT DISTINCT {KEYS} FROM e_old) k USING ({KEYS})
UNION ALL SELECT o.project_id, o.id, 'resolved' FROM e_old o ANTI JOIN e_new n USING ({KEYS})
""",
)
block(
    "e_audits",
    """
SELECT project_id, run_date, max(ts) AS ts, count(*) AS violations, count(*) FILTER (WHERE severity = 'error') AS errors,
       count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS info,
       min(config_hash) AS config_hash,
       count(*) FILTER (WHERE severity = 'error') * 3 + count(*) FILTER (WHERE severity = 'warning') AS debt
FROM e_viol GROUP BY 1, 2
""",
)
block(
    "e_deltas",
    """
SELECT *, violations - lag(violations) OVER w AS vd, debt - lag(debt) OVER w AS dd FROM e_audits
WINDOW w AS (PARTITION BY project_id ORDER BY run_date)
""",
)
block("e_projects", "SELECT DISTINCT 'p' || (user_id % 7) AS project_id FROM events")


def log(spark: SparkSession, folder: str) -> DataFrame:
    return violations_from_events(spark, folder)


def sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = log(spark, folder)
    split = F.lit(SPLIT).cast("date")
    return rows.where(F.col("run_date") < split), rows.where(F.col("run_date") >= split)


def audits(spark: SparkSession, folder: str) -> DataFrame:
    return history.audits_from_violations(log(spark, folder))


# --- diffs ---------------------------------------------------------------------


@query(
    "h1_fingerprint",
    "SELECT project_id, rule_id || ':' || source_layer || ':' || target_layer || ':' || import_path AS fp, count(*) AS n "
    "FROM e_viol GROUP BY 1, 2",
)
def h1(spark: SparkSession, folder: str) -> DataFrame:
    return diffs.fingerprint(log(spark, folder)).groupBy("project_id", "fp").agg(F.count(F.lit(1)).alias("n"))


@query("h2_diff_runs", "SELECT * FROM e_diff")
def h2(spark: SparkSession, folder: str) -> DataFrame:
    old, new = sides(spark, folder)
    cols = [*diffs.KEYS, "ts", "id", "file"]
    return diffs.diff_runs(old.select(*cols), new.select(*cols), ["ts", "id"]).select(*diffs.KEYS, "id", "file", "change")


@query("h2_compare_refs", "SELECT project_id, change, count(*) AS n FROM e_diff GROUP BY 1, 2")
def h2_refs(spark: SparkSession, folder: str) -> DataFrame:
    ref = F.when(F.col("run_date") < F.lit(SPLIT).cast("date"), "main").otherwise("topic")
    rows = log(spark, folder).select(*diffs.KEYS, "file", "line", "message", ref.alias("ref"))
    return compare_refs(rows, "main", "topic").groupBy("project_id", "change").agg(F.count(F.lit(1)).alias("n"))


@query("h3_watch_diff", "SELECT * FROM e_watch")
def h3(spark: SparkSession, folder: str) -> DataFrame:
    old, new = sides(spark, folder)
    return diffs.watch_diff(old, new).select("project_id", "id", "change")


@query(
    "h4_baseline_generate",
    "SELECT project_id, config_hash, max(ts) AS generated_at, rule_id, source_layer, target_layer, import_path, file, count(*) AS n "
    "FROM e_old GROUP BY ALL",
)
def h4(spark: SparkSession, folder: str) -> DataFrame:
    old, _ = sides(spark, folder)
    made = diffs.baseline_generate(old, F.col("config_hash"), F.col("ts"))
    rest = [c for c in made.columns if c != "generated_at"]
    return made.groupBy(*rest).agg(F.max("generated_at").alias("generated_at"), F.count(F.lit(1)).alias("n"))


def _baseline(old: DataFrame) -> DataFrame:
    return diffs.baseline_generate(old, F.col("config_hash"), F.col("ts"))


@query("h5_baseline_filter", "SELECT project_id, id FROM e_watch WHERE change = 'added'")
def h5(spark: SparkSession, folder: str) -> DataFrame:
    old, new = sides(spark, folder)
    return diffs.baseline_filter(new, _baseline(old)).select("project_id", "id")


@query("h6_suppressed_count", "SELECT project_id, count(*) AS suppressed FROM e_watch WHERE change = 'unchanged' GROUP BY 1")
def h6(spark: SparkSession, folder: str) -> DataFrame:
    old, new = sides(spark, folder)
    return diffs.suppressed_count(new, _baseline(old)).withColumn("suppressed", F.col("suppressed").cast("bigint"))


@query(
    "h7_baseline_stale",
    "SELECT n.project_id, coalesce(b.h <> n.h, true) AS stale FROM (SELECT project_id, min(config_hash) AS h FROM e_new GROUP BY 1) n "
    "LEFT JOIN (SELECT project_id, arg_max(config_hash, (ts, config_hash)) AS h FROM e_old WHERE project_id <> 'p3' GROUP BY 1) b USING (project_id)",
)
def h7(spark: SparkSession, folder: str) -> DataFrame:
    old, new = sides(spark, folder)
    now = new.groupBy("project_id").agg(F.min("config_hash").alias("config_hash"))
    return diffs.baseline_stale(now, _baseline(old.where("project_id <> 'p3'")))


@query(
    "h8_snapshot_fingerprint",
    f"SELECT project_id, run_date, {digest_sql('sha256(id)')} AS fingerprint FROM e_viol GROUP BY 1, 2",
)
def h8(spark: SparkSession, folder: str) -> DataFrame:
    return history.snapshot_fingerprint(log(spark, folder))


@query("h9_snapshot_diff", "SELECT * FROM e_diff WHERE change <> 'unchanged'")
def h9(spark: SparkSession, folder: str) -> DataFrame:
    old, new = sides(spark, folder)
    cols = [*diffs.KEYS, "ts", "id", "file"]
    return history.snapshot_diff(old.select(*cols), new.select(*cols), ["ts", "id"]).select(
        *diffs.KEYS, "id", "file", "change"
    )


@query(
    "h12_related_violations",
    "SELECT v.project_id, v.id, v.rule_id, v.file FROM e_viol v, (SELECT rule_id, file FROM e_viol WHERE id = 'E-17') t "
    "WHERE v.rule_id = t.rule_id OR v.file = t.file",
)
def h12(spark: SparkSession, folder: str) -> DataFrame:
    rows = log(spark, folder)
    return diffs.related_violations(rows, rows.where("id = 'E-17'")).select("project_id", "id", "rule_id", "file")


block(
    "e_hunks",
    "SELECT project_id, file, id, line AS s, line + CASE WHEN k = '' THEN 0 ELSE CAST(k AS INT) - 1 END AS e FROM "
    "(SELECT *, CASE WHEN line % 3 = 0 THEN '' ELSE CAST(line % 5 + 1 AS VARCHAR) END AS k FROM e_viol)",
)


def _suggestions(spark: SparkSession, folder: str) -> DataFrame:
    line = F.col("line")
    size = F.when(line % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(","), (line % 5 + 1).cast("string")))
    head = F.concat(F.lit("@@ -1,2 +"), line.cast("string"), size, F.lit(" @@"))
    rows = log(spark, folder).select("project_id", "file", F.col("id").alias("violation_id"), head.alias("diff"))
    return guidance.parse_hunk_range(rows)


@query(
    "x23_parse_hunk_range",
    "SELECT project_id, id AS violation_id, s AS start_line, e AS end_line FROM e_hunks",
)
def x23(spark: SparkSession, folder: str) -> DataFrame:
    return _suggestions(spark, folder).select("project_id", "violation_id", "start_line", "end_line")


@query(
    "h13_fix_conflicts",
    """
SELECT project_id, file, sa AS start_a, ea AS end_a, sb AS start_b, eb AS end_b, min(ia) AS first_a, min(ib) AS first_b,
       CASE WHEN sa = sb AND ea = eb THEN count(DISTINCT ia) * (count(DISTINCT ia) - 1) // 2 ELSE count(*) END AS n_pairs
FROM (SELECT a.project_id, a.file, a.s AS sa, a.e AS ea, b.s AS sb, b.e AS eb, a.id AS ia, b.id AS ib
      FROM e_hunks a JOIN e_hunks b ON a.project_id = b.project_id AND a.file = b.file
      WHERE NOT (a.s = 0 AND a.e = 0) AND NOT (b.s = 0 AND b.e = 0) AND (a.s, a.e) <= (b.s, b.e)
            AND a.s - 3 <= b.e + 3 AND b.s - 3 <= a.e + 3) GROUP BY 1, 2, 3, 4, 5, 6
HAVING CASE WHEN sa = sb AND ea = eb THEN count(DISTINCT ia) > 1 ELSE true END
""",
)
def h13(spark: SparkSession, folder: str) -> DataFrame:
    return diffs.fix_conflicts(_suggestions(spark, folder))


@query(
    "h14_config_changed",
    "SELECT project_id, a.h IS DISTINCT FROM b.h AS config_changed FROM "
    "(SELECT project_id, arg_max(config_hash, ts) AS h FROM e_old GROUP BY 1) a FULL JOIN "
    "(SELECT project_id, arg_max(config_hash, ts) AS h FROM e_new GROUP BY 1) b USING (project_id)",
)
def h14(spark: SparkSession, folder: str) -> DataFrame:
    old, new = sides(spark, folder)
    return diffs.config_changed(old, new)


@query(
    "h17_change_summary",
    "SELECT project_id, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'resolved') AS resolved, "
    "count(*) FILTER (WHERE change = 'unchanged') AS unchanged, count(*) FILTER (WHERE change <> 'unchanged') > 0 AS has_changes, "
    "'+' || count(*) FILTER (WHERE change = 'added') || ' violations, -' || count(*) FILTER (WHERE change = 'resolved') || ' resolved, ' || "
    "count(*) FILTER (WHERE change = 'unchanged') || ' unchanged' AS summary, (SELECT arg_max(config_hash, ts) FROM e_old o WHERE o.project_id = d.project_id) IS DISTINCT FROM "
    "(SELECT arg_max(config_hash, ts) FROM e_new n WHERE n.project_id = d.project_id) AS config_changed FROM e_diff d GROUP BY 1",
)
def h17(spark: SparkSession, folder: str) -> DataFrame:
    old, new = sides(spark, folder)
    cols = [*diffs.KEYS, "ts", "id"]
    changes = diffs.diff_runs(old.select(*cols), new.select(*cols), ["ts", "id"])
    return diffs.change_summary(changes, ["project_id"], diffs.config_changed(old, new))


# --- history -------------------------------------------------------------------


@query(
    "g17_snapshot_breakdown",
    "SELECT project_id, run_date, string_agg(severity || '=' || n, ',' ORDER BY severity) AS by_severity FROM "
    "(SELECT project_id, run_date, severity, count(*) AS n FROM e_viol GROUP BY 1, 2, 3) GROUP BY 1, 2",
)
def g17(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.snapshot_breakdown(log(spark, folder))
    text = F.transform(
        F.map_entries("by_severity"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return rows.select("project_id", "run_date", F.array_join(text, ",").alias("by_severity"))


@query(
    "t1_trend_points",
    "SELECT project_id, run_date AS date, violations AS total, errors, warnings, info FROM e_audits",
)
def t1(spark: SparkSession, folder: str) -> DataFrame:
    return history.trend_points(audits(spark, folder))


@query(
    "t2_trend_report",
    """
SELECT project_id, run_date, coalesce(vd, 0) AS violation_delta, coalesce(dd, 0) AS debt_delta,
  CASE WHEN vd IS NULL THEN 'unchanged' WHEN vd < 0 OR dd < 0 THEN 'improved' WHEN vd > 0 OR dd > 0 THEN 'degraded' ELSE 'unchanged' END AS status,
  CASE WHEN vd IS NULL THEN 'No previous audit for comparison'
       WHEN vd < 0 AND dd < 0 THEN 'Architecture improved: reduced violations and debt'
       WHEN vd < 0 THEN 'Architecture improved: reduced violations'
       WHEN dd < 0 THEN 'Architecture improved: reduced technical debt'
       WHEN vd > 0 AND dd > 0 THEN 'Architecture degraded: increased violations and debt'
       WHEN vd > 0 THEN 'Architecture degraded: increased violations'
       WHEN dd > 0 THEN 'Architecture degraded: increased technical debt'
       ELSE 'Architecture unchanged from previous audit' END AS summary
FROM e_deltas
""",
)
def t2(spark: SparkSession, folder: str) -> DataFrame:
    return history.trend_report(audits(spark, folder)).select(
        "project_id", "run_date", "violation_delta", "debt_delta", "status", "summary"
    )


@query(
    "t3_debt_trend",
    "SELECT project_id, run_date, coalesce(dd, 0) AS trend_delta, CASE WHEN dd > 0 THEN 'up' WHEN dd < 0 THEN 'down' ELSE 'stable' END AS trend FROM e_deltas",
)
def t3(spark: SparkSession, folder: str) -> DataFrame:
    return history.debt_trend(audits(spark, folder)).select("project_id", "run_date", "trend_delta", "trend")


@query(
    "t4_latest_snapshot",
    "SELECT project_id, run_date, violations, debt FROM e_audits QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY ts DESC) = 1",
)
def t4(spark: SparkSession, folder: str) -> DataFrame:
    return history.latest_snapshot(audits(spark, folder)).select("project_id", "run_date", "violations", "debt")


@query("t5_since_filter", "SELECT project_id, run_date, violations FROM e_audits WHERE run_date >= DATE '2024-01-20'")
def t5(spark: SparkSession, folder: str) -> DataFrame:
    # the date filter goes below the aggregation, so earlier days are never counted
    return history.since_filter(audits(spark, folder), "2024-01-20").select("project_id", "run_date", "violations")


@query(
    "t6_retention",
    "SELECT project_id, run_date, row_number() OVER (PARTITION BY project_id ORDER BY run_date DESC) <= 10 AS kept FROM e_audits",
)
def t6(spark: SparkSession, folder: str) -> DataFrame:
    return history.retention(audits(spark, folder)).select("project_id", "run_date", "kept")


@query(
    "t7_daily_upsert",
    "SELECT project_id, run_date, ts, id, severity FROM e_viol QUALIFY row_number() OVER (PARTITION BY project_id, run_date ORDER BY ts DESC, id DESC) = 1",
)
def t7(spark: SparkSession, folder: str) -> DataFrame:
    return history.daily_upsert(log(spark, folder).select("project_id", "run_date", "ts", "id", "severity"))


@query(
    "t8_clean_streak",
    """
SELECT project_id, ts, violations, CASE WHEN violations > 0 THEN 0 ELSE run % 3 END AS streak,
       violations = 0 AND run % 3 = 0 AS refresh
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id, island ORDER BY ts) - CASE WHEN island = 0 THEN 0 ELSE 1 END AS BIGINT) AS run
      FROM (SELECT *, sum(CASE WHEN violations > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island
            FROM (SELECT project_id, ts, CAST(max(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) AS INTEGER) AS violations FROM e_viol GROUP BY 1, 2)))
""",
)
def t8(spark: SparkSession, folder: str) -> DataFrame:
    runs = log(spark, folder).groupBy("project_id", "ts").agg(
        F.max((F.col("severity") == "error").cast("int")).alias("violations")
    )
    return history.clean_streak(runs, 3)


@query("t9_ttl_filter", "SELECT project_id, id FROM e_viol WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOURS")
def t9(spark: SparkSession, folder: str) -> DataFrame:
    return history.ttl_filter(log(spark, folder), F.lit("2024-01-30 12:00:00").cast("timestamp")).select("project_id", "id")


# --- expectations ---------------------------------------------------------------


def _expect(name: str, sql: str, columns) -> None:
    query(name, sql)(lambda spark, folder: log(spark, folder).agg(*[c.alias(n) for n, c in columns().items()]))


_expect(
    "q1_expect_count",
    "SELECT count(*) FILTER (WHERE rule_id = 'rule-error') = 2014 AS exact, count(*) = 5 AS wrong FROM e_viol",
    lambda: {"exact": expect_count(F.col("rule_id") == "rule-error", 2014), "wrong": expect_count(F.lit(True), 5)},
)
_expect(
    "q2_expect_files",
    "SELECT bool_or(regexp_matches(file, '^src/u1[^/]*[.]py$')) AS one, bool_or(starts_with(file, 'src/') AND ends_with(file, '7.py')) AS deep, "
    "bool_or(regexp_matches(file, '^lib/[^/]*$')) AS none FROM e_viol",
    lambda: {
        "one": expect_files(F.lit(True), ("src/u1*.py",)),
        "deep": expect_files(F.lit(True), ("src/**7.py",)),
        "none": expect_files(F.lit(True), ("lib/*",)),
    },
)
_expect(
    "q3_expect_layers",
    "SELECT bool_or(source_layer = 'domain' AND target_layer = 'infrastructure') AS pair, bool_or(target_layer = 'ghost') AS target FROM e_viol",
    lambda: {
        "pair": expect_layers(F.lit(True), (("domain", "infrastructure"),)),
        "target": expect_layers(F.lit(True), (("", "ghost"),)),
    },
)
_expect(
    "q4_expect_patterns",
    "SELECT bool_or(regexp_matches(message, 'error at 4[0-9]')) AS hit, bool_or(regexp_matches(message, '^panic')) AS miss FROM e_viol",
    lambda: {
        "hit": expect_patterns(F.lit(True), ("([", "error at 4[0-9]")),
        "miss": expect_patterns(F.lit(True), ("^panic",)),
    },
)
CASES = [
    Expectation("errors", "rule-error", files=("src/**",), layers=(("domain", ""),)),
    Expectation("clicks", "rule-click", violations=3, patterns=("^panic",)),
    Expectation("all", patterns=("purchase",)),
    Expectation("ghost", "rule-ghost", violations=0),
]
block(
    "e_suite",
    """
SELECT 'errors' AS case_name, true AS passed, 'all expectations met' AS details
UNION ALL SELECT 'clicks', false, 'expected 3 violations, got ' || (SELECT count(*) FROM e_viol WHERE rule_id = 'rule-click') || '; no violations matched any pattern'
UNION ALL SELECT 'all', (SELECT bool_or(message LIKE '%purchase%') FROM e_viol), 'all expectations met'
UNION ALL SELECT 'ghost', (SELECT count(*) = 0 FROM e_viol WHERE rule_id = 'rule-ghost'), 'all expectations met'
""",
)


@query("q5_expect_suite", "SELECT * FROM e_suite")
def q5(spark: SparkSession, folder: str) -> DataFrame:
    return expect_suite(log(spark, folder), CASES)


@query(
    "q5_suite_passed",
    "SELECT count(*) AS cases, count(*) FILTER (WHERE passed) AS passed_cases, bool_and(passed) AS passed FROM e_suite",
)
def q5_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return suite_passed(expect_suite(log(spark, folder), CASES))


# --- reports -------------------------------------------------------------------


@query(
    "s10_export_json",
    """
SELECT project_id, '{"id":"' || id || '","rule_id":"' || rule_id || '","severity":"' || severity || '","file":"' || file || '","line":' || line ||
  ',"source_layer":"' || source_layer || '","target_layer":"' || target_layer || '","import":"' || import_path || '","message":"' || message || '"' ||
  CASE WHEN overridden THEN ',"overridden":true' ELSE '' END || '}' AS payload FROM e_viol
""",
)
def s10(spark: SparkSession, folder: str) -> DataFrame:
    return exports.json_rows(log(spark, folder))


def uri(path: str) -> str:
    """A folder as the URI that tasks open."""
    return path if "://" in path else "file://" + path.removeprefix("file:")


@query(
    "s10_export_documents",
    "SELECT project_id, id, rule_id, severity, file, line, import_path AS import, message, overridden, "
    "count(*) OVER (PARTITION BY project_id) AS total, count(*) FILTER (WHERE severity = 'error') OVER (PARTITION BY project_id) AS errors FROM e_viol",
)
def s10_documents(spark: SparkSession, folder: str) -> DataFrame:
    from catalogue.streams import scratch

    root, work, rows = uri(scratch(spark, "documents")), uri(scratch(spark, "parts")), log(spark, folder)
    written = exports.json_documents(rows, rows.select("project_id"), root, work)
    # read back: every file is one document
    fields = "id string, rule_id string, severity string, file string, line int, `import` string, message string, overridden boolean"
    schema = f"violations array<struct<{fields.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>, summary struct<total:long,errors:long>"
    found = spark.read.schema(schema).option("multiLine", "true").json(root).withColumn("name", F.regexp_extract(F.input_file_name(), "([^/]+)[.]json$", 1))
    name = F.regexp_extract("file", "([^/]+)[.]json$", 1)
    named = found.join(written.select("project_id", name.alias("name")), "name")
    return named.select("project_id", "summary.total", "summary.errors", F.inline("violations")).withColumn(
        "overridden", F.coalesce("overridden", F.lit(False))
    )


@query(
    "s10_export_json_summary",
    """
SELECT project_id, '{"schema_version":"1.0","summary":{"total":' || count(*) || ',"errors":' || count(*) FILTER (WHERE severity = 'error') ||
  ',"warnings":' || count(*) FILTER (WHERE severity = 'warning') || ',"info":' || count(*) FILTER (WHERE severity = 'info') ||
  ',"overridden_count":' || count(*) FILTER (WHERE overridden) || '}}' AS payload FROM e_viol GROUP BY 1
""",
)
def s10_summary(spark: SparkSession, folder: str) -> DataFrame:
    return exports.json_summary(log(spark, folder))


@query(
    "s11_export_sarif",
    "SELECT project_id, rule_id, CASE WHEN severity = 'warning' THEN 'warning' ELSE 'error' END AS level, message AS text, file AS uri, "
    "line AS start_line, source_layer, target_layer, import_path FROM e_viol",
)
def s11(spark: SparkSession, folder: str) -> DataFrame:
    rows = log(spark, folder)
    wrapped = F.when(
        F.col("line") % 2 == 0, F.concat("source_layer", F.lit(" ("), "file", F.lit(":"), F.col("line").cast("string"), F.lit(")"))
    ).otherwise(F.col("file"))
    return exports.sarif_results(rows.withColumn("file", wrapped))


@query(
    "s12_export_junit",
    "SELECT project_id, id AS name, file AS classname, CASE severity WHEN 'error' THEN 'failure' WHEN 'warning' THEN 'skipped' ELSE 'passed' END AS outcome, "
    "CASE WHEN severity = 'info' THEN '' ELSE source_layer || ' → ' || target_layer END AS detail, CASE WHEN severity = 'error' THEN message ELSE '' END AS body FROM e_viol",
)
def s12(spark: SparkSession, folder: str) -> DataFrame:
    return exports.junit_cases(log(spark, folder))


@query(
    "s12_export_junit_suite",
    "SELECT project_id, count(*) AS tests, count(*) FILTER (WHERE severity = 'error') AS failures, count(*) FILTER (WHERE severity = 'warning') AS skipped FROM e_viol GROUP BY 1",
)
def s12_suite(spark: SparkSession, folder: str) -> DataFrame:
    return exports.junit_suite(log(spark, folder))


@query(
    "s13_export_annotations",
    "SELECT project_id, '::' || CASE severity WHEN 'warning' THEN 'warning' WHEN 'info' THEN 'notice' ELSE 'error' END || ' file=' || file || ',line=' || line || "
    "',title=' || rule_id || '::100%25 ' || message || '%0A' AS value FROM e_viol",
)
def s13(spark: SparkSession, folder: str) -> DataFrame:
    rows = log(spark, folder).withColumn("message", F.concat(F.lit("100% "), "message", F.lit("\n")))
    return exports.annotation_lines(rows)


@query(
    "s14_export_markdown_summary",
    """
SELECT project_id, ord, '| ' || metric || ' | ' || n || ' |' AS value FROM (
  SELECT project_id, 0 AS ord, 'Total Violations' AS metric, count(*) AS n FROM e_viol GROUP BY 1
  UNION ALL SELECT project_id, 1, 'Errors', count(*) FILTER (WHERE severity = 'error') FROM e_viol GROUP BY 1
  UNION ALL SELECT project_id, 2, 'Warnings', count(*) FILTER (WHERE severity = 'warning') FROM e_viol GROUP BY 1
  UNION ALL SELECT project_id, 3, 'Info', count(*) FILTER (WHERE severity = 'info') FROM e_viol GROUP BY 1
  UNION ALL SELECT project_id, 4, 'Files Affected', count(DISTINCT file) FROM e_viol GROUP BY 1
  UNION ALL SELECT project_id, 5, 'Rules Violated', count(DISTINCT rule_id) FROM e_viol GROUP BY 1)
""",
)
def s14(spark: SparkSession, folder: str) -> DataFrame:
    return exports.markdown_summary(log(spark, folder))


@query(
    "s14_export_markdown_pairs",
    "SELECT project_id, '| ' || source_layer || ' → ' || target_layer || ' | ' || count(*) || ' |' AS value FROM e_viol GROUP BY project_id, source_layer, target_layer",
)
def s14_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return exports.markdown_pairs(log(spark, folder))


# --- batch twins of the streams ---------------------------------------------------

block(
    "e_changes",
    """
SELECT 'p' || (user_id % 7) AS project_id, 'src/u' || user_id || '/k' || regexp_extract(props, '"k": *([0-9]+)', 1) || '.py' AS path,
       CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'rename' ELSE 'write' END AS op, ts FROM events
""",
)
block(
    "e_bursts",
    """
SELECT project_id, burst, path, arg_max(op, (ts, op)) AS op FROM (
  SELECT *, CAST(sum(first) OVER (PARTITION BY project_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT) AS burst FROM (
    SELECT c.*, CASE WHEN row_number() OVER (PARTITION BY project_id, ts) = 1 AND (prev IS NULL OR ts - prev >= INTERVAL 3600 SECONDS) THEN 1 ELSE 0 END AS first
    FROM e_changes c JOIN (SELECT project_id, ts, lag(ts) OVER (PARTITION BY project_id ORDER BY ts) AS prev FROM (SELECT DISTINCT project_id, ts FROM e_changes)) USING (project_id, ts)))
GROUP BY 1, 2, 3
""",
)


@query("w1_debounce_batch", "SELECT * FROM e_bursts")
def w1_batch(spark: SparkSession, folder: str) -> DataFrame:
    return watch.debounce_batch(changes_from_events(spark, folder), 3600)


@query(
    "w2_ignore_batch",
    "SELECT project_id, count(*) AS n FROM e_changes WHERE NOT starts_with(path, 'src/u1/') AND NOT path LIKE '%7.py' AND NOT contains(path, '/u33/') GROUP BY 1",
)
def w2_batch(spark: SparkSession, folder: str) -> DataFrame:
    kept = watch.ignore_events(changes_from_events(spark, folder), ["src/u1/*", "*7.py", "u33/"])
    return kept.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w6_state_batch",
    "SELECT project_id, '{\"total\":' || count(*) || ',\"errors\":' || count(*) FILTER (WHERE severity = 'error') || ',\"warnings\":' || count(*) FILTER (WHERE severity = 'warning') || "
    "',\"info\":' || count(*) FILTER (WHERE severity = 'info') || ',\"debt\":' || (count(*) FILTER (WHERE severity = 'error') * 3 + count(*) FILTER (WHERE severity = 'warning')) || '}' AS payload "
    "FROM e_viol GROUP BY 1",
)
def w6_batch(spark: SparkSession, folder: str) -> DataFrame:
    return watch.state_payload(log(spark, folder)).select("project_id", "payload")


@query(
    "w7_windows_batch",
    "SELECT project_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, severity, count(*) AS cnt FROM e_viol GROUP BY 1, 2, 4",
)
def w7_batch(spark: SparkSession, folder: str) -> DataFrame:
    return watch.violation_windows(log(spark, folder), "1 day")


@query(
    "s9_delete_old",
    "SELECT project_id, run_date, violations, (SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY project_id ORDER BY run_date DESC) AS n FROM e_audits) WHERE n > 10) AS deleted "
    "FROM e_audits QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY run_date DESC) <= 10",
)
def s9_delete(spark: SparkSession, folder: str) -> DataFrame:
    from catalogue.streams import scratch
    from strata.sources.history_store import HistoryStore

    store = HistoryStore(spark, scratch(spark, "history"))
    rows = audits(spark, folder)
    store.save(rows.withColumn("violations", F.lit(-1).cast("bigint")))
    store.save(rows)
    store.compact()
    deleted = store.delete_old(10)
    return store.load().select("project_id", "run_date", "violations", F.lit(deleted).cast("long").alias("deleted"))


@query(
    "s9_history_store",
    "SELECT project_id, run_date, violations, debt FROM e_audits",
)
def s9(spark: SparkSession, folder: str) -> DataFrame:
    from catalogue.streams import scratch
    from strata.sources.history_store import HistoryStore

    store = HistoryStore(spark, scratch(spark, "history"))
    rows = audits(spark, folder)
    early = rows.where("run_date < date'2024-01-20'")
    # the first save holds wrong numbers for the days that the second one repeats
    store.save(early.withColumn("violations", F.lit(0).cast("bigint")).withColumn("ts", F.col("ts") - F.expr("interval 1 day")))
    store.save(rows)
    return store.load().select("project_id", "run_date", "violations", "debt")

