"""Set differences, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import materialise

FINGERPRINT = ["rule_id", "source_layer", "target_layer", "import_path"]
KEYS = ["project_id", *FINGERPRINT]


def fingerprint(violations: DataFrame) -> DataFrame:
    """H1 ``fingerprint``: rule, layers and import; neither file nor line.

    Joins use the four columns; the string is for display and storage.
    """
    return violations.withColumn("fp", F.concat_ws(":", *FINGERPRINT))


def _last_per_key(rows: DataFrame, order: list[str]) -> DataFrame:
    # max over a struct is a map-side aggregate: a hot fingerprint never moves whole
    rest = [c for c in rows.columns if c not in KEYS and c not in order]
    return (
        rows.groupBy(*KEYS)
        .agg(F.max(F.struct(*order, *rest)).alias("_r"))
        .select(*KEYS, *[F.col(f"_r.{c}").alias(c) for c in order + rest])
    )


def diff_runs(before: DataFrame, after: DataFrame, order: list[str]) -> DataFrame:
    """H2 ``diff_runs``: one row per fingerprint with its change.

    On each side the last occurrence by ``order`` is kept; the surviving row is
    the one after, except for resolved fingerprints.
    """
    old, new = _last_per_key(before, order), _last_per_key(after, order)
    rest = [c for c in new.columns if c not in KEYS]
    a = old.select(*KEYS, F.struct(*rest).alias("_old"))
    b = new.select(*KEYS, F.struct(*rest).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "resolved").otherwise("unchanged")
    )
    return (
        a.join(b, KEYS, "full_outer")
        .withColumns({"change": change, "_kept": F.coalesce("_new", "_old")})
        .select(*KEYS, *[F.col(f"_kept.{c}").alias(c) for c in rest], "change")
    )


def watch_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """H3 ``watch_diff``: like H2 but every duplicate row is kept.

    Each side joins the other's distinct keys, so the right side is unique and
    hot keys only exist on the split-able left side.
    """
    old_keys = previous.select(*KEYS).distinct().withColumn("_seen", F.lit(True))
    new_keys = current.select(*KEYS).distinct()
    now = current.join(old_keys, KEYS, "left").withColumn(
        "change", F.when(F.col("_seen"), "unchanged").otherwise("added")
    )
    gone = previous.join(new_keys, KEYS, "left_anti").withColumn("change", F.lit("resolved"))
    return now.drop("_seen").unionByName(gone)


def baseline_generate(violations: DataFrame, config_hash: Column, generated_at: Column) -> DataFrame:
    """H4 ``baseline_generate``: keep the fingerprint fields and the file."""
    return violations.select(
        "project_id",
        config_hash.alias("config_hash"),
        generated_at.alias("generated_at"),
        *FINGERPRINT,
        "file",
    )


def baseline_filter(violations: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """H5 ``baseline_filter``: drop violations the baseline already has."""
    if baseline is None:
        return violations
    return violations.join(baseline.select(*KEYS).distinct(), KEYS, "left_anti")


def suppressed_count(violations: DataFrame, baseline: DataFrame) -> DataFrame:
    """H6 ``suppressed_count``: violations per project the baseline hides.

    Both sides shrink to distinct fingerprints before they meet.
    """
    counts = violations.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.join(baseline.select(*KEYS).distinct(), KEYS, "left_semi")
        .groupBy("project_id")
        .agg(F.sum("n").alias("suppressed"))
    )


def config_hash(*parts: Column) -> Column:
    """SHA-256 of a config's JSON form."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def baseline_stale(projects: DataFrame, baseline: DataFrame) -> DataFrame:
    """H7 ``baseline_stale``: no baseline, or made under another config.

    ``projects`` has (project_id, config_hash).
    """
    made = baseline.groupBy("project_id").agg(F.max(F.struct("generated_at", "config_hash")).alias("b"))
    return projects.join(made, "project_id", "left").select(
        "project_id", (F.col("b").isNull() | (F.col("b.config_hash") != F.col("config_hash"))).alias("stale")
    )


def pr_filter(violations: DataFrame, changed: DataFrame, compat: bool = False) -> DataFrame:
    """H10 ``pr_filter``: violations on lines a change adds, outside the files it deletes.

    ``changed`` has the files of ``extraction.diff_files`` or the lines of ``parse_diff``.
    Adds ``pr``: each change is judged by its own lines alone, so a violation on a
    line that two changes add is returned for both. A file counts as deleted when
    the change leaves it no new-side line; ``compat=True`` counts any file with a
    removed line.
    """
    if "added" not in changed.columns:
        line = F.col("new_line")
        changed = changed.groupBy("project_id", "pr", "file").agg(
            F.max(line > 0).alias("kept"),
            F.max((line == 0) & (F.col("old_line") > 0)).alias("cut"),
            F.collect_set(F.when((F.col("old_line") == 0) & (line > 0), line)).alias("added"),
        )
    alive = changed.where("size(added) > 0").where("not cut" if compat else "kept or not cut")
    # a change meets each violation of its files once
    near = violations.join(alive.select("project_id", "file", "pr", "added"), ["project_id", "file"])
    return near.where(F.array_contains("added", F.col("line"))).select(*violations.columns, "pr")


def pr_annotations(violations: DataFrame) -> DataFrame:
    """H11 ``pr_annotations``: one annotation per new violation."""
    return violations.select(
        "project_id",
        *[c for c in violations.columns if c == "pr"],
        F.col("file").alias("path"),
        F.col("line").alias("start_line"),
        F.col("line").alias("end_line"),
        F.lit("failure").alias("annotation_level"),
        "message",
        F.concat(F.lit("["), "rule_id", F.lit("] "), "source_layer", F.lit(" → "), "target_layer").alias("title"),
    )


def pr_summary(new: DataFrame, everything: DataFrame, changes: DataFrame) -> DataFrame:
    """H11 totals: pass flag and summary text per change (project_id, pr).

    The totals, a row a project, are written: planned on their size, the join need not
    gather a project's changes in one task.
    """
    n = new.groupBy("project_id", "pr").agg(F.count(F.lit(1)).alias("n_new"))
    total = materialise(everything.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_total")))
    out = (
        changes.select("project_id", "pr")
        .distinct()
        .join(n, ["project_id", "pr"], "left")
        .join(total, "project_id", "left")
        .na.fill(0, ["n_new", "n_total"])
        .withColumn("passed", F.col("n_new") == 0)
    )
    good = F.concat(
        F.lit("✅ No new architecture violations in this PR ("),
        F.col("n_total").cast("string"),
        F.lit(" total violations unchanged)."),
    )
    bad = F.concat(F.lit("❌ "), F.col("n_new").cast("string"), F.lit(" new architecture violation(s) found in this PR."))
    return out.withColumn("summary", F.when(F.col("passed"), good).otherwise(bad))


def related_violations(violations: DataFrame, target: DataFrame) -> DataFrame:
    """H12 ``related_violations``: same rule or same file as a given violation.

    ``target`` is that one violation's row; its two values enter as scalar
    subqueries, so the big table is filtered in place, neither joined nor
    shuffled.
    """
    rule, file = target.select("rule_id").scalar(), target.select("file").scalar()
    return violations.where((F.col("rule_id") == rule) | (F.col("file") == file))


def fix_conflicts(suggestions: DataFrame, tolerance: int = 3, bin_lines: int = 16) -> DataFrame:
    """H13 ``fix_conflicts``: overlapping fixes of one file, as pairs of line ranges.

    Suggestions with the same range are one group with a count, and ``n_pairs``
    is the exact number of conflicting suggestion pairs, so a thousand fixes of
    one line cost one row. Ranges meet through an equi-join on (file, line
    bin); a pair is kept only in the bin where its overlap starts. ``conflict_members``
    lists the suggestions behind the ranges.
    """
    keys = ["project_id", "file"]
    ranges = (
        suggestions.where("not (start_line = 0 and end_line = 0)")
        .groupBy(*keys, "start_line", "end_line")
        .agg(F.count(F.lit(1)).alias("n"), F.min("violation_id").alias("first_id"))
    )
    low, high = F.col("start_line") - tolerance, F.col("end_line") + tolerance
    bins = F.sequence(F.floor(low / bin_lines), F.floor(high / bin_lines))
    placed = ranges.withColumns({"low": low, "high": high}).withColumn("bin", F.explode(bins))
    a = placed.select(*keys, "bin", *[F.col(c).alias(f"{c}_a") for c in ("start_line", "end_line", "low", "high", "n", "first_id")])
    b = placed.select(*keys, "bin", *[F.col(c).alias(f"{c}_b") for c in ("start_line", "end_line", "low", "high", "n", "first_id")])
    met = a.join(b, [*keys, "bin"]).where(
        (F.col("low_a") <= F.col("high_b"))
        & (F.col("low_b") <= F.col("high_a"))
        & (F.col("bin") == F.floor(F.greatest("low_a", "low_b") / bin_lines))
    )
    same = (F.col("start_line_a") == F.col("start_line_b")) & (F.col("end_line_a") == F.col("end_line_b"))
    ordered = F.struct("start_line_a", "end_line_a") < F.struct("start_line_b", "end_line_b")
    pairs = F.when(same, F.floor(F.col("n_a") * (F.col("n_a") - 1) / 2)).otherwise(F.col("n_a") * F.col("n_b"))
    return (
        met.where(same | ordered)
        .withColumn("n_pairs", pairs.cast("bigint"))
        .where("n_pairs > 0")
        .select(
            *keys,
            F.col("start_line_a").alias("start_a"),
            F.col("end_line_a").alias("end_a"),
            F.col("start_line_b").alias("start_b"),
            F.col("end_line_b").alias("end_b"),
            F.col("first_id_a").alias("first_a"),
            F.col("first_id_b").alias("first_b"),
            "n_pairs",
        )
    )


def conflict_members(suggestions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """H13 members: the suggestions on each line range that takes part in a conflict.

    Together with the pairs of ranges this names every conflicting pair:
    (project_id, file, start_line, end_line, violation_id).
    """
    keys = ["project_id", "file", "start_line", "end_line"]
    sides = [
        conflicts.select("project_id", "file", F.col(f"start_{x}").alias("start_line"), F.col(f"end_{x}").alias("end_line"))
        for x in ("a", "b")
    ]
    hit = sides[0].union(sides[1]).distinct()
    return suggestions.select(*keys, "violation_id").join(hit, keys, "left_semi")


def config_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """H14 ``config_changed``: does a project's config hash differ between two runs?"""
    a = before.groupBy("project_id").agg(F.max_by("config_hash", "ts").alias("hash_before"))
    b = after.groupBy("project_id").agg(F.max_by("config_hash", "ts").alias("hash_after"))
    return a.join(b, "project_id", "full_outer").select(
        "project_id", (~F.col("hash_before").eqNullSafe(F.col("hash_after"))).alias("config_changed")
    )


def code_context(violations: DataFrame, files: DataFrame, around: int = 3) -> DataFrame:
    """H16 ``code_context``: source lines around each violation, the line itself marked.

    Violations shrink to one row per file with its line numbers (no more than
    the file has lines). That table is written, so its size is known when it
    meets the files, and the few lines are cut out inside the file row: the
    corpus is neither exploded nor, for a small right side, shuffled.
    """
    spots = materialise(
        violations.where("file <> '' and line > 0")
        .groupBy("project_id", F.col("file").alias("path"))
        .agg(F.collect_set("line").alias("at"))
    )
    hit = files.select("project_id", "path", "content").join(spots, ["project_id", "path"])

    def cut(rows: Column) -> Column:
        def near(line: Column) -> Column:
            numbers = F.sequence(F.greatest(line - around, F.lit(1)), F.least(line + around, F.size(rows)))
            return F.transform(
                numbers, lambda n: F.struct(line.alias("line"), n.alias("line_no"), F.get(rows, n - 1).alias("text"))
            )

        inside = F.filter("at", lambda line: line <= F.size(rows))
        return F.flatten(F.transform(inside, near))

    # the split text is bound once, as the only element of an outer array
    cuts = F.flatten(F.transform(F.array(F.split("content", "\n")), cut))
    return (
        hit.select("project_id", F.col("path").alias("file"), F.explode(cuts).alias("c"))
        .select("project_id", "file", "c.*")
        .withColumn("marker", F.when(F.col("line_no") == F.col("line"), "→").otherwise(" "))
    )


def change_summary(changes: DataFrame, keys: list[str], changed: DataFrame | None = None) -> DataFrame:
    """H17 ``change_summary``: change counts and flags per pair of runs."""
    out = changes.groupBy(*keys).agg(
        *[F.count(F.when(F.col("change") == c, F.lit(1))).alias(c) for c in ("added", "resolved", "unchanged")]
    )
    counts = [F.col(c).cast("string") for c in ("added", "resolved", "unchanged")]
    summary = F.concat(
        F.lit("+"), counts[0], F.lit(" violations, -"), counts[1], F.lit(" resolved, "), counts[2], F.lit(" unchanged")
    )
    out = out.withColumns({"has_changes": (F.col("added") > 0) | (F.col("resolved") > 0), "summary": summary})
    if changed is not None:
        out = out.join(changed, keys, "left").na.fill(False, ["config_changed"])
    return out
