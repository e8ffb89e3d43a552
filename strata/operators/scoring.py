"""Aggregations and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.model import CIRCULAR_PENALTY, SEVERITY_WEIGHTS



def coupling_matrix(edges: DataFrame) -> DataFrame:
    """G1 ``coupling_matrix``: classified edges per layer pair."""
    return (
        edges.where("source_layer is not null and resolved_layer is not null")
        .groupBy("project_id", F.col("source_layer").alias("from_layer"), F.col("resolved_layer").alias("to_layer"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def coupling_pct(coupling: DataFrame) -> DataFrame:
    """G2 ``coupling_pct``: share of the project's edges, in percent.

    The window runs over layer pairs, of which a project has a handful.
    """
    total = F.sum("cnt").over(W.partitionBy("project_id"))
    return coupling.withColumn("pct", F.when(total > 0, F.col("cnt") / total * 100).otherwise(F.lit(0.0)))


def coupling_total(coupling: DataFrame) -> DataFrame:
    """G3 ``coupling_total``: edges per project."""
    return coupling.groupBy("project_id").agg(F.sum("cnt").alias("total"))


def coupling_get(coupling: DataFrame, source: str, target: str) -> DataFrame:
    """G3 point lookup, 0 when the pair is absent."""
    hit = (F.col("from_layer") == source) & (F.col("to_layer") == target)
    return coupling.groupBy("project_id").agg(F.sum(F.when(hit, F.col("cnt")).otherwise(0)).alias("cnt"))


def coupling_pivot(coupling: DataFrame, layers: list[str]) -> DataFrame:
    """G4 ``coupling_pivot``: matrix view with one column per target layer.

    The axis is the configured layer list, so no extra pass discovers it.
    """
    return (
        coupling.groupBy("project_id", "from_layer").pivot("to_layer", sorted(layers)).agg(F.sum("cnt")).na.fill(0)
    )


def coupling_band(coupling: DataFrame) -> DataFrame:
    """G5 ``coupling_band``: band by count, and by share when ``pct`` is present."""
    out = coupling.withColumn(
        "band", F.when(F.col("cnt") > 10, "high").when(F.col("cnt") > 5, "medium").otherwise("")
    )
    if "pct" in coupling.columns:
        out = out.withColumn(
            "pct_band", F.when(F.col("pct") <= 5, "low").when(F.col("pct") <= 15, "medium").otherwise("high")
        )
    return out


def layer_stats(coupling: DataFrame) -> DataFrame:
    """G6 ``layer_stats``: fan-out, fan-in, net and heavy flags; self-edges skipped."""
    cross = F.col("from_layer") != F.col("to_layer")
    sides = coupling.select(
        "project_id",
        F.explode(
            F.array(
                F.struct(
                    F.col("from_layer").alias("layer"),
                    F.when(cross, F.col("cnt")).otherwise(0).alias("outgoing"),
                    F.lit(0).cast("bigint").alias("incoming"),
                ),
                F.struct(
                    F.col("to_layer").alias("layer"),
                    F.lit(0).cast("bigint").alias("outgoing"),
                    F.when(cross, F.col("cnt")).otherwise(0).alias("incoming"),
                ),
            )
        ).alias("s"),
    ).select("project_id", "s.*")
    sums = sides.groupBy("project_id", "layer").agg(
        F.sum("outgoing").alias("outgoing"), F.sum("incoming").alias("incoming")
    )
    return sums.withColumns(
        {
            "net": F.col("incoming") - F.col("outgoing"),
            "source_heavy": F.col("outgoing") > F.col("incoming"),
            "target_heavy": F.col("incoming") > F.col("outgoing"),
        }
    )


def _tally(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def severity_columns() -> list[Column]:
    """Counts by severity; unknown severities count as errors."""
    known = F.col("severity").isin("warning", "info")
    return [
        F.count(F.lit(1)).alias("total"),
        _tally(~known).alias("errors"),
        _tally(F.col("severity") == "warning").alias("warnings"),
        _tally(F.col("severity") == "info").alias("info"),
    ]


def severity_counts(violations: DataFrame, keys: list[str]) -> DataFrame:
    """G7 ``severity_counts`` per key."""
    return violations.groupBy(*keys).agg(*severity_columns())


def severity_map(violations: DataFrame, keys: list[str]) -> DataFrame:
    """G7 as a map column, severities as they are (an export form)."""
    counts = violations.groupBy(*keys, "severity").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("severity", "n")))
    return counts.groupBy(*keys).agg(F.map_from_entries(pairs).alias("by_severity"))


def debt_of(errors: Column, warnings: Column, info: Column) -> Column:
    """Weighted debt of severity counts."""
    return (
        errors * SEVERITY_WEIGHTS["error"] + warnings * SEVERITY_WEIGHTS["warning"] + info * SEVERITY_WEIGHTS["info"]
    )


def debt_score(violations: DataFrame, pair_counts: DataFrame) -> DataFrame:
    """G8 ``debt_score``: weighted total and a separate circular penalty.

    The total counts only the three known severities; ``pair_counts`` comes
    from F6 and lists every project.
    """
    sums = violations.groupBy("project_id").agg(
        *[_tally(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "info"))]
    )
    return (
        pair_counts.join(sums, "project_id", "left")
        .na.fill(0, ["errors", "warnings", "info"])
        .select(
            "project_id",
            "errors",
            "warnings",
            "info",
            debt_of(F.col("errors"), F.col("warnings"), F.col("info")).alias("total"),
            (F.col("pair_count") * CIRCULAR_PENALTY).alias("penalty"),
        )
    )


def violation_breakdown(violations: DataFrame) -> DataFrame:
    """G9 ``violation_breakdown``: counts by file, by rule and by layer pair in one pass.

    Grouping sets expand each row three times before the map-side aggregate.
    Returns (project_id, kind, key, cnt).
    """
    entry = F.explode(
        F.array(
            F.struct(F.lit("file").alias("kind"), F.col("file").alias("key")),
            F.struct(F.lit("rule").alias("kind"), F.col("rule_id").alias("key")),
            F.struct(
                F.lit("pair").alias("kind"), F.concat("source_layer", F.lit(" → "), "target_layer").alias("key")
            ),
        )
    )
    return (
        violations.select("project_id", entry.alias("x"))
        .groupBy("project_id", F.col("x.kind").alias("kind"), F.col("x.key").alias("key"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def affected(breakdown: DataFrame) -> DataFrame:
    """G9 totals: files affected and rules violated, from the breakdown itself."""
    return breakdown.groupBy("project_id").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "rule", F.col("cnt"))), F.lit(0)).alias("total"),
        _tally(F.col("kind") == "file").alias("files_affected"),
        _tally(F.col("kind") == "rule").alias("rules_violated"),
    )


def debt_band(debt: DataFrame) -> DataFrame:
    """G10 ``debt_band``."""
    return debt.withColumn(
        "band", F.when(F.col("total") > 50, "poor").when(F.col("total") > 20, "moderate").otherwise("good")
    )


def violation_density(counts: DataFrame) -> DataFrame:
    """G11 ``violation_density``: violations per 1000 lines; 0 without lines.

    Input has ``violations`` and ``lines`` columns.
    """
    return counts.withColumn(
        "density",
        F.when(F.col("lines") > 0, F.col("violations") / (F.col("lines") / 1000.0)).otherwise(F.lit(0.0)),
    )


def project_lines(files: DataFrame) -> DataFrame:
    """Lines of code per project, counted inside each file row (no line explode)."""
    return files.groupBy("project_id").agg(F.sum(F.size(F.split("content", "\n")).cast("bigint")).alias("lines"))


def run_metrics(deps: DataFrame) -> DataFrame:
    """G12 ``run_metrics``: files, dependencies and extractors that ran."""
    return deps.groupBy("project_id").agg(
        F.count_distinct("source_file").alias("files"),
        F.count(F.lit(1)).alias("total_deps"),
        F.count_distinct("language").alias("detectors_run"),
    )


def detector_status(
    applicable: DataFrame,
    languages: list[str],
    deps: DataFrame,
    projects: DataFrame,
    failures: DataFrame | None = None,
) -> DataFrame:
    """G13 ``detector_status``: per project and language, applicable or not, edges and error.

    ``failures`` (project_id, language, error) lists extractors that gave up.
    """
    grid = (
        projects.select("project_id")
        .distinct()
        .select("project_id", F.explode(F.array(*[F.lit(x) for x in languages])).alias("language"))
    )
    seen = applicable.select("project_id", "language").distinct().withColumn("applicable", F.lit(True))
    counts = deps.groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("dep_count"))
    if failures is None:
        grid = grid.withColumn("error", F.lit(""))
    else:
        errors = failures.groupBy("project_id", "language").agg(F.min("error").alias("error"))
        grid = grid.join(errors, ["project_id", "language"], "left").na.fill("", ["error"])
    return (
        grid.join(seen, ["project_id", "language"], "left")
        .join(counts, ["project_id", "language"], "left")
        .na.fill(False, ["applicable"])
        .na.fill(0, ["dep_count"])
        .withColumn("dep_count", F.when(F.col("applicable"), F.col("dep_count")).otherwise(F.lit(0)))
    )


def import_summary(scan: DataFrame) -> DataFrame:
    """G14 ``import_summary``: light-scan counts per layer pair."""
    return scan.groupBy("project_id", "source_layer", "target_layer").agg(F.count(F.lit(1)).alias("cnt"))


def gate(violations: DataFrame, projects: DataFrame, max_violations: int = 0) -> DataFrame:
    """G15 ``gate``: pass/fail per project; overridden rows do not count."""
    counts = violations.groupBy("project_id").agg(_tally(~F.col("overridden")).alias("counted"))
    allowed = F.col("counted") <= max_violations if max_violations > 0 else F.col("counted") == 0
    return (
        projects.select("project_id")
        .distinct()
        .join(counts, "project_id", "left")
        .na.fill(0, ["counted"])
        .withColumn("passed", allowed)
    )


def project_report(violations: DataFrame, projects: DataFrame) -> DataFrame:
    """G16 ``project_report``: summary per project, clean projects included.

    ``projects`` may carry an ``error`` column; an error fails the project.
    """
    base = projects if "error" in projects.columns else projects.withColumn("error", F.lit(""))
    return (
        base.select("project_id", "error")
        .distinct()
        .join(severity_counts(violations, ["project_id"]), "project_id", "left")
        .na.fill(0, ["total", "errors", "warnings", "info"])
        .withColumn("status", F.when((F.col("total") > 0) | (F.col("error") != ""), "fail").otherwise("pass"))
    )


def workspace_report(reports: DataFrame) -> DataFrame:
    """G16 ``workspace_report``: fleet totals over project reports."""
    failed = F.col("status") == "fail"
    return reports.agg(
        F.count(F.lit(1)).alias("total_projects"),
        _tally(failed).alias("failed_projects"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_violations"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"),
        F.coalesce(F.sum("info"), F.lit(0)).alias("info"),
    ).withColumn("passed", F.col("failed_projects") == 0)


def snapshot_breakdown(violations: DataFrame, snapshot: str = "run_date") -> DataFrame:
    """G17 ``snapshot_breakdown``: severity map per snapshot."""
    return severity_map(violations, ["project_id", snapshot])
