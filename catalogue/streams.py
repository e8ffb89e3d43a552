"""Queries that run a stream over the driver tables until it is drained."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.base import query
from strata.operators import extraction, resolution, rules
from strata.operators.corpus import filter_source_files
from strata.session import shared_dir
from strata.sources.adapters import (
    ALIASES,
    CORPUS,
    CORPUS_LAYERS,
    change_columns,
    file_columns,
    files_from_documents,
    table,
    violation_columns,
)
from strata.streaming import watch


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table as a file stream."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def arriving(spark: SparkSession, parts: list[DataFrame], drain: Callable[[DataFrame, str], None]) -> None:
    """Write the parts one after the other below one folder, draining a stream over it after each."""
    place, state = scratch(spark, "arriving"), scratch(spark, "check")
    for part in parts:
        part.write.mode("append").parquet(place)
        drain(spark.readStream.schema(part.schema).parquet(place), state)


@query(
    "w1_debounce_changes",
    """
SELECT project_id, path, op, count(*) AS n FROM e_bursts JOIN (
  SELECT project_id, burst, ended FROM (SELECT project_id, burst, max(ts) AS ended FROM (
    SELECT *, CAST(sum(first) OVER (PARTITION BY project_id ORDER BY ts) AS BIGINT) AS burst FROM (
      SELECT *, CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 3600 SECONDS THEN 1 ELSE 0 END AS first FROM (
        SELECT project_id, ts, lag(ts) OVER (PARTITION BY project_id ORDER BY ts) AS prev FROM (SELECT DISTINCT project_id, ts FROM e_changes)))) GROUP BY 1, 2)
  WHERE ended + INTERVAL 3600 SECONDS <= (SELECT max(ts) FROM e_changes)) USING (project_id, burst) GROUP BY 1, 2, 3
""",
)
def w1(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch(spark, "bursts")
    changes = change_columns(stream(spark, folder, "events"))
    watch.run_available(watch.debounce_changes(changes, 3600, buckets=16), scratch(spark, "check"), out=out)
    bursts = watch.merge_bursts(spark.read.parquet(out), 3600)
    # without a delay the watermark is the newest event of all
    now = table(spark, folder, "events").select(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("now"))
    over = bursts.where(F.unix_micros("until") + 3_600_000_000 <= now.select("now").scalar())
    return over.groupBy("project_id", "path", "op").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w2_ignore_events",
    "SELECT project_id, path, op, ts FROM e_changes WHERE NOT starts_with(path, 'src/u1/') AND NOT path LIKE '%7.py' AND NOT contains(path, '/u33/')",
)
def w2(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch(spark, "kept")
    kept = watch.ignore_events(change_columns(stream(spark, folder, "events")), ["src/u1/*", "*7.py", "u33/"])
    watch.run_available(kept, scratch(spark, "check"), out=out)
    return spark.read.parquet(out)


@query("w3_incremental_check", "SELECT * FROM c_viol")
def w3(spark: SparkSession, folder: str) -> DataFrame:
    def extract(changed: DataFrame) -> DataFrame:
        return extraction.extract_imports(filter_source_files(changed))

    def check(found: DataFrame, present: DataFrame) -> DataFrame:
        deps = resolution.resolve_imports(found, present, CORPUS_LAYERS, ALIASES)
        return rules.standard_violations(deps, CORPUS)

    out = scratch(spark, "violations")
    known = files_from_documents(spark, folder).select("project_id", "path", "content").withColumns(
        {"op": F.lit("write"), "ts": F.lit("2024-01-01").cast("timestamp")}
    )
    # build files of the corpus come first, then the documents; the second run restarts from the first's checkpoint
    stems = file_columns(table(spark, folder, "documents")).select("project_id", "path")
    parts = [known.join(stems, ["project_id", "path"], how) for how in ("left_anti", "left_semi")]
    builds = F.col("path").isin("go.mod", "pom.xml", "build.gradle", "build.gradle.kts")
    body = watch.incremental_check(extract(known.drop("op", "ts")).schema, check, out)
    arriving(spark, parts, lambda changed, state: watch.run_available(watch.project_snapshots(changed, extract, builds), state, each=body))
    # the newest verdict of every project
    found = spark.read.parquet(out)
    newest = found.groupBy("project_id").agg(F.max("epoch").alias("epoch"))
    return found.join(newest, ["project_id", "epoch"], "left_semi").drop("rule_ord", "original_severity", "overridden", "epoch")


@query(
    "w4_change_feed",
    """
WITH RECURSIVE v AS (SELECT 'p' || (user_id % 7) AS project_id, CAST(ts AS DATE) AS run_date, 'E-' || event_id AS id, event_type, user_id % 4 AS s, k % 4 AS t, k % 20 AS m
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)),
a AS (SELECT * FROM v WHERE run_date < DATE '2024-01-30' QUALIFY run_date = max(run_date) OVER (PARTITION BY project_id)),
b AS (SELECT * FROM v QUALIFY run_date = max(run_date) OVER (PARTITION BY project_id))
SELECT project_id, id, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.project_id = b.project_id AND a.event_type = b.event_type AND a.s = b.s AND a.t = b.t AND a.m = b.m) THEN 'unchanged' ELSE 'added' END AS change FROM b
UNION ALL SELECT project_id, id, 'resolved' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.project_id = b.project_id AND a.event_type = b.event_type AND a.s = b.s AND a.t = b.t AND a.m = b.m)
""",
)
def w4(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch(spark, "changes")
    runs = violation_columns(table(spark, folder, "events")).withColumn("ts", F.col("run_date").cast("timestamp"))

    def headed(rows: DataFrame) -> DataFrame:
        return rows.unionByName(rows.select("project_id", "ts").distinct(), allowMissingColumns=True)

    # two runs of the fleet, each a project's newest in the log: the second one sees a day more
    parts = [headed(watch.newest_runs(log)) for log in (runs.where("run_date < date'2024-01-30'"), runs)]
    arriving(spark, parts, lambda found, state: watch.run_available(watch.change_feed(found), state, out=out))
    found = spark.read.parquet(out)
    newest = found.groupBy("project_id").agg(F.max("run").alias("run"))
    return found.join(newest, ["project_id", "run"], "left_semi").select("project_id", "id", "change")


@query("w5_periodic_refresh", "SELECT project_id, id, severity FROM e_viol")
def w5(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch(spark, "refresh")
    ticks = violation_columns(stream(spark, folder, "events")).select("project_id")

    def check(due: DataFrame) -> DataFrame:
        found = violation_columns(table(spark, folder, "events")).select("project_id", "id", "severity")
        return found.join(due, "project_id", "left_semi")

    writer = ticks.writeStream.foreachBatch(watch.refresh(check, out)).option("checkpointLocation", scratch(spark, "check"))
    running = watch.periodic(writer, "1 second").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    found = spark.read.parquet(out)
    newest = found.groupBy("project_id").agg(F.max("epoch").alias("epoch"))
    return found.join(newest, ["project_id", "epoch"], "left_semi").drop("epoch")


@query(
    "w6_state_payload",
    "SELECT project_id, count(*) AS total, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, "
    "count(*) FILTER (WHERE severity = 'info') AS info FROM e_viol GROUP BY 1",
)
def w6(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch(spark, "payload")
    payload = watch.state_payload(violation_columns(stream(spark, folder, "events")))

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    watch.run_available(payload, scratch(spark, "check"), each=save, mode="update")
    rest = ("total", "errors", "warnings", "info")
    last = spark.read.parquet(out).groupBy("project_id").agg(F.max(F.struct("epoch", *rest)).alias("p"))
    return last.select("project_id", *[F.col(f"p.{c}").alias(c) for c in rest])


@query(
    "w7_violation_windows",
    "SELECT project_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, severity, count(*) AS cnt "
    "FROM e_viol GROUP BY 1, 2, 4 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
)
def w7(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch(spark, "windows")
    counts = watch.violation_windows(violation_columns(stream(spark, folder, "events")), "1 day")
    watch.run_available(counts, scratch(spark, "check"), out=out)
    return spark.read.parquet(out)


@query(
    "w7_sliding_windows",
    """
SELECT project_id, s AS window_start, s + INTERVAL 2 DAYS AS window_end, severity, count(*) AS cnt FROM (
  SELECT project_id, severity, time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * unnest([0, 1]) AS s FROM e_viol) GROUP BY 1, 2, 4
HAVING s + INTERVAL 2 DAYS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""",
)
def w7_sliding(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch(spark, "sliding")
    counts = watch.violation_windows(violation_columns(stream(spark, folder, "events")), "2 days", "1 day")
    watch.run_available(counts, scratch(spark, "check"), out=out)
    return spark.read.parquet(out)


@query(
    "w7_sliding_batch",
    """
SELECT project_id, s AS window_start, s + INTERVAL 2 DAYS AS window_end, severity, count(*) AS cnt FROM (
  SELECT project_id, severity, time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * unnest([0, 1]) AS s FROM e_viol) GROUP BY 1, 2, 4
""",
)
def w7_sliding_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of all rows, those the stream hasn't closed yet included."""
    return watch.violation_windows(violation_columns(table(spark, folder, "events")), "2 days", "1 day")


@query(
    "w8_late_events",
    "SELECT project_id, time_bucket(INTERVAL 6 HOURS, ts) AS window_start, count(*) AS cnt FROM e_viol GROUP BY 1, 2 "
    "HAVING time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)",
)
def w8(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch(spark, "on-time")
    on_time = watch.late_events(violation_columns(stream(spark, folder, "events")), "1 day")
    counts = (
        on_time.groupBy("project_id", F.window("ts", "6 hours").alias("w"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select("project_id", F.col("w.start").alias("window_start"), "cnt")
    )
    watch.run_available(counts, scratch(spark, "check"), out=out)
    return spark.read.parquet(out)
