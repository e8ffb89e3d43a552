"""Expectation suites over violation sets (Q1-Q5)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.globs import any_of, matches_any


@dataclass(frozen=True)
class Expectation:
    """One test case; an unset matcher is not checked."""

    name: str
    rule_id: str = ""
    violations: int | None = None
    files: tuple[str, ...] = ()
    layers: tuple[tuple[str, str], ...] = ()
    patterns: tuple[str, ...] = ()


def expect_count(scope: Column, expected: int) -> Column:
    """Q1 ``expect_count``: exact number of violations in scope."""
    return F.count(F.when(scope, F.lit(1))) == expected


def _exists(condition: Column) -> Column:
    return F.coalesce(F.max(F.coalesce(condition, F.lit(False)).cast("int")), F.lit(0)) == 1


def expect_files(scope: Column, globs: tuple[str, ...]) -> Column:
    """Q2 ``expect_files``: some violation's file matches some glob."""
    return _exists(scope & matches_any(F.col("file"), globs, "expect"))


def expect_layers(scope: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Q3 ``expect_layers``: some violation matches a source, a target or both."""
    tests = []
    for source, target in pairs:
        sides = []
        if source:
            sides.append(F.col("source_layer") == source)
        if target:
            sides.append(F.col("target_layer") == target)
        if sides:
            tests.append(sides[0] if len(sides) == 1 else sides[0] & sides[1])
    return _exists(scope & any_of(tests))


def expect_patterns(scope: Column, patterns: tuple[str, ...]) -> Column:
    """Q4 ``expect_patterns``: some message matches some regex; a broken regex is skipped."""
    good = []
    for pattern in patterns:
        text = engine_pattern(pattern)
        if text is not None:
            good.append(F.col("message").rlike(text))
    return _exists(scope & any_of(good))


def engine_pattern(pattern: str) -> str | None:
    """The pattern as Spark's regex engine takes it, or None where that rejects it."""
    text = pattern.replace("(?P<", "(?<")
    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(text)
    except IllegalArgumentException:
        return None
    return text


def expect_suite(violations: DataFrame, cases: list[Expectation]) -> DataFrame:
    """Q5 ``expect_suite``: evaluate every case in one aggregate pass.

    Returns (case_name, passed, details); all matchers of a case must hold.
    The suite passes when every case does and there is at least one.
    """
    checks: list[Column] = []
    shape: list[tuple[str, list[tuple[str, str]]]] = []
    for i, case in enumerate(cases):
        scope = F.col("rule_id") == case.rule_id if case.rule_id else F.lit(True)
        parts: list[tuple[str, str]] = []

        def add(kind: str, test: Column, i: int = i, parts: list = parts) -> None:
            checks.append(test.alias(f"c{i}_{kind}"))
            parts.append((kind, f"c{i}_{kind}"))

        if case.violations is not None:
            add("count", expect_count(scope, case.violations))
            checks.append(F.count(F.when(scope, F.lit(1))).alias(f"c{i}_n"))
        if case.files:
            add("files", expect_files(scope, case.files))
        if case.layers:
            add("layers", expect_layers(scope, case.layers))
        if case.patterns:
            add("patterns", expect_patterns(scope, case.patterns))
        shape.append((case.name, parts))
    schema = "case_name string, passed boolean, details string"
    if not checks:
        rows = [(case.name, True, "all expectations met") for case in cases]
        return violations.sparkSession.createDataFrame(rows, schema)
    measured = violations.agg(*checks)
    texts = {
        "files": "no violations matched any file pattern",
        "layers": "no violations matched any layer expectation",
        "patterns": "no violations matched any pattern",
    }
    results = []
    for i, (case, (name, parts)) in enumerate(zip(cases, shape)):
        passed, failures = F.lit(True), []
        for kind, column in parts:
            passed = passed & F.col(column)
            text = (
                F.concat(
                    F.lit(f"expected {case.violations} violations, got "), F.col(f"c{i}_n").cast("string")
                )
                if kind == "count"
                else F.lit(texts[kind])
            )
            failures.append(F.when(~F.col(column), text))
        details = F.concat_ws("; ", *failures) if failures else F.lit("")
        results.append(
            F.struct(
                F.lit(name).alias("case_name"),
                passed.alias("passed"),
                F.when(passed, "all expectations met").otherwise(details).alias("details"),
            )
        )
    return measured.select(F.explode(F.array(*results)).alias("r")).select("r.*")


def suite_passed(results: DataFrame) -> DataFrame:
    """Q5 verdict: all cases pass and the suite is not empty."""
    return results.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count(F.when(F.col("passed"), 1)).alias("passed_cases"),
        (F.coalesce(F.min(F.col("passed").cast("int")), F.lit(0)) == 1).alias("passed"),
    )
