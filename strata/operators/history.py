"""Snapshot time series (T1-T9) and snapshot digests (H8, H9).

A project has at most one audit per calendar date once T7 has run, so windows
over a project's dates stay small whatever the fleet does. Runs are not bounded
like that, so streaks use the ordered scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.operators.diffs import diff_runs
from strata.operators.ordered import set_digest, since_last
from strata.operators.scoring import debt_of



def audits_from_violations(violations: DataFrame) -> DataFrame:
    """One audit per project and run date: totals, debt, config hash."""
    counted = violations.groupBy("project_id", "run_date").agg(
        F.max("ts").alias("ts"),
        F.count(F.lit(1)).alias("violations"),
        F.count(F.when(F.col("severity") == "error", F.lit(1))).alias("errors"),
        F.count(F.when(F.col("severity") == "warning", F.lit(1))).alias("warnings"),
        F.count(F.when(F.col("severity") == "info", F.lit(1))).alias("info"),
        F.min("config_hash").alias("config_hash"),
    )
    return counted.withColumn("debt", debt_of(F.col("errors"), F.col("warnings"), F.col("info")))


def snapshot_fingerprint(violations: DataFrame, snapshot: str = "run_date") -> DataFrame:
    """H8 ``snapshot_fingerprint``: digest of a snapshot's violation ids."""
    return set_digest(violations, ["project_id", snapshot], "id", name="fingerprint")


def snapshot_diff(snapshot: DataFrame, current: DataFrame, order: list[str]) -> DataFrame:
    """H9 ``snapshot_diff``: added and resolved against a snapshot."""
    return diff_runs(snapshot, current, order).where("change <> 'unchanged'")


def trend_points(snapshots: DataFrame) -> DataFrame:
    """T1 ``trend_points``: counts per snapshot, newest first."""
    return snapshots.select(
        "project_id", F.col("run_date").alias("date"), F.col("violations").alias("total"), "errors", "warnings", "info"
    ).orderBy("project_id", F.desc("date"))


def _previous(name: str) -> Column:
    return F.lag(name).over(W.partitionBy("project_id").orderBy("run_date"))


def trend_report(audits: DataFrame) -> DataFrame:
    """T2 ``trend_report``: deltas against the previous audit; improved wins on mixed signs."""
    v, d = F.col("violation_delta"), F.col("debt_delta")
    status = (
        F.when(v.isNull(), "unchanged").when((v < 0) | (d < 0), "improved").when((v > 0) | (d > 0), "degraded")
    ).otherwise("unchanged")
    improved = (
        F.when((v < 0) & (d < 0), "Architecture improved: reduced violations and debt")
        .when(v < 0, "Architecture improved: reduced violations")
        .otherwise("Architecture improved: reduced technical debt")
    )
    degraded = (
        F.when((v > 0) & (d > 0), "Architecture degraded: increased violations and debt")
        .when(v > 0, "Architecture degraded: increased violations")
        .otherwise("Architecture degraded: increased technical debt")
    )
    summary = (
        F.when(v.isNull(), "No previous audit for comparison")
        .when(F.col("status") == "improved", improved)
        .when(F.col("status") == "degraded", degraded)
        .otherwise("Architecture unchanged from previous audit")
    )
    return (
        audits.withColumns(
            {
                "violation_delta": F.col("violations") - _previous("violations"),
                "debt_delta": F.col("debt") - _previous("debt"),
            }
        )
        .withColumn("status", status)
        .withColumn("summary", summary)
        .withColumns({"violation_delta": F.coalesce(v, F.lit(0)), "debt_delta": F.coalesce(d, F.lit(0))})
    )


def debt_trend(audits: DataFrame) -> DataFrame:
    """T3 ``debt_trend``: up, down or stable against the previous audit."""
    delta = F.coalesce(F.col("debt") - _previous("debt"), F.lit(0))
    return audits.withColumn("trend_delta", delta).withColumn(
        "trend",
        F.when(F.col("trend_delta") > 0, "up").when(F.col("trend_delta") < 0, "down").otherwise("stable"),
    )


def _newest(rows: DataFrame, ts: str, rest: list[str]) -> Column:
    """The whole row with the latest ``ts``; ties go by the other columns, maps by their text."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    order = [F.to_json(F.col(c)) if "map<" in kinds[c] else F.col(c) for c in rest]
    return F.max_by(F.struct(ts, *rest), F.struct(ts, *[c.alias(f"o{i}") for i, c in enumerate(order)]))


def latest_snapshot(snapshots: DataFrame, ts: str = "ts") -> DataFrame:
    """T4 ``latest_snapshot``: newest row per project, by a map-side aggregate."""
    rest = [c for c in snapshots.columns if c not in ("project_id", ts)]
    newest = snapshots.groupBy("project_id").agg(_newest(snapshots, ts, rest).alias("s"))
    return newest.select("project_id", *[F.col(f"s.{c}").alias(c) for c in [ts, *rest]])


def since_filter(audits: DataFrame, date: str) -> DataFrame:
    """T5 ``since_filter``: audits on or after a date (prunes the date partitions)."""
    return audits.where(F.col("run_date") >= F.lit(date).cast("date"))


def retention(audits: DataFrame, keep: int = 10) -> DataFrame:
    """T6 ``retention``: newest ``keep`` audits per project stay; the rest is marked deleted."""
    rank = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("run_date")))
    return audits.withColumn("kept", rank <= keep)


def daily_upsert(audits: DataFrame, ts: str = "ts") -> DataFrame:
    """T7 ``daily_upsert``: one audit per project and date, the last one wins."""
    rest = [c for c in audits.columns if c not in ("project_id", "run_date", ts)]
    last = audits.groupBy("project_id", "run_date").agg(_newest(audits, ts, rest).alias("a"))
    return last.select("project_id", "run_date", *[F.col(f"a.{c}").alias(c) for c in [ts, *rest]])


def clean_streak(runs: DataFrame, threshold: int = 3, compat: bool = False) -> DataFrame:
    """T8 ``clean_streak``: consecutive clean runs and the runs that trigger a refresh.

    ``runs`` has (project_id, ts, violations). The streak restarts after a dirty
    run and after each refresh; ``compat=True`` counts every run as clean. A
    project should have one run at a time; tied runs count in some fixed order.
    """
    dirty = F.lit(False) if compat else F.col("violations") > 0
    marked = since_last(runs, ["project_id"], ["ts"], dirty, "_length")
    length = F.col("_length")
    refresh = (length > 0) & (F.lit(threshold) > 0) & (length % max(threshold, 1) == 0)
    streak = F.when(F.lit(threshold > 0), length % max(threshold, 1)).otherwise(length)
    return marked.select(
        *runs.columns, streak.cast("bigint").alias("streak"), refresh.alias("refresh")
    )


def ttl_filter(violations: DataFrame, now: Column, hours: int = 24, ts: str = "ts") -> DataFrame:
    """T9 ``ttl_filter``: drop cached violations older than the time to live."""
    return violations.where(F.col(ts) >= now - F.make_interval(hours=F.lit(hours)))
