"""Expression metrics.

Each builtin is an aggregate Column over the classified edge table, so any
number of metrics of any number of rules costs one grouped pass. Rules are
plain Column expressions over the resulting one-row-per-project table and
state the bad condition: truthy means violation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.model import Layer

# --- fixed values: edge fields an expression may name ------------------------
FIELDS = {
    "SourceFile": "source_file",
    "ImportPath": "import_path",
    "ResolvedLayer": "resolved_layer",
    "SourceLine": "source_line",
}
# ----------------------------------------------------------------------------


def expr_deps(source: str, target: str) -> Column:
    """E2 ``expr_deps``: predicate selecting the edges from one layer to another."""
    return (F.col("source_layer") == source) & (F.col("resolved_layer") == target)


def expr_filter(edges: Column, predicate: str) -> Column:
    """E11 ``expr_filter``: narrow an edge predicate by ``field op value``.

    String fields allow == and !=; the line number allows all six comparisons.
    """
    parts = predicate.split()
    if len(parts) != 3 or parts[0] not in FIELDS:
        raise ValueError(f"invalid predicate {predicate!r}")
    name, op, value = parts
    column = F.col(FIELDS[name])
    if name == "SourceLine":
        return edges & expr_compare(column, op, F.lit(int(value)))
    if op not in ("==", "!="):
        raise ValueError(f"invalid operator {op!r} for {name}")
    column = F.coalesce(column, F.lit(""))
    return edges & ((column == value) if op == "==" else (column != value))


def expr_count(edges: Column) -> Column:
    """E1 ``expr_count`` of an edge predicate: number of matching edges."""
    return F.coalesce(F.sum(F.when(edges, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def as_int(value: Column, kind: str = "int") -> Column:
    """E1 on other values: booleans count 0/1, lists count their length."""
    if kind == "bool":
        return value.cast("bigint")
    if kind == "list":
        return F.size(value).cast("bigint")
    return value.cast("bigint")


def expr_layers(layers: tuple[Layer, ...]) -> Column:
    """E3 ``expr_layers``: number of configured layers."""
    return F.lit(len(layers)).cast("bigint")


def expr_files(layer: str) -> Column:
    """E5 ``expr_files``: distinct source files of a layer, among files with edges."""
    return F.count_distinct(F.when(F.col("source_layer") == layer, F.col("source_file")))


def expr_ratio(part: Column, whole: Column) -> Column:
    """E6 ``expr_ratio``: integer division, 0 when the divisor is 0."""
    safe = F.when(whole == 0, F.lit(1).cast("bigint")).otherwise(whole)
    return F.when(whole == 0, F.lit(0).cast("bigint")).otherwise(((part - part % safe) / safe).cast("bigint"))


def expr_threshold(value: Column, low, high) -> Column:
    """E8 ``expr_threshold``: low <= value <= high."""
    return value.between(F.lit(low), F.lit(high))


def expr_any(edges: Column) -> Column:
    """E10 ``expr_any``: is there any matching edge?"""
    return expr_count(edges) > 0


expr_all = expr_any  # E9: the same test under its other name


def expr_map(edges: DataFrame, predicate: Column, field: str) -> DataFrame:
    """E12 ``expr_map``: one field of the matching edges, duplicates kept.

    Long form: one row per value, so a list of any length stays distributed.
    """
    return edges.where(predicate).select("project_id", F.col(FIELDS[field]).cast("string").alias("value"))


def expr_compare(left: Column, op: str, right: Column) -> Column:
    """E13 ``expr_compare``: six comparisons."""
    table: dict[str, Callable[[], Column]] = {
        "==": lambda: left == right,
        "!=": lambda: left != right,
        "<": lambda: left < right,
        "<=": lambda: left <= right,
        ">": lambda: left > right,
        ">=": lambda: left >= right,
    }
    if op not in table:
        raise ValueError(f"invalid operator {op!r}")
    return table[op]()


def truthy(value: Column, kind: str = "int") -> Column:
    """E14 ``expr_logic``: a number is true above zero, a list when not empty."""
    if kind == "bool":
        return value
    return (F.size(value) if kind == "list" else value) > 0


def expr_and(*values: Column) -> Column:
    """All items hold."""
    out = values[0]
    for value in values[1:]:
        out = out & value
    return out


def evaluate_metrics(edges: DataFrame, projects: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One row per project with every metric; projects without edges get zeros.

    ``metrics`` are aggregate Columns; all of them share one pass.
    """
    found = edges.groupBy("project_id").agg(*[c.alias(n) for n, c in metrics.items()])
    out = projects.select("project_id").distinct().join(found, "project_id", "left")
    kinds = {f.name: f.dataType.typeName() for f in found.schema}
    return out.withColumns(
        {n: F.coalesce(F.col(n), F.lit(False) if kinds[n] == "boolean" else F.lit(0)) for n in metrics}
    )


def expr_violations(violations: DataFrame, projects: DataFrame, rules: dict[str, str]) -> DataFrame:
    """E7 ``expr_violations``: violations per rule id; ``rules`` maps output name to id."""
    return evaluate_metrics(
        violations, projects, {name: F.count(F.when(F.col("rule_id") == rule, 1)) for name, rule in rules.items()}
    )


def expr_has_circular(cycles: DataFrame, projects: DataFrame) -> DataFrame:
    """E4 ``expr_has_circular``: does the project have any layer cycle?"""
    found = cycles.select("project_id").distinct().withColumn("has_circular", F.lit(True))
    return (
        projects.select("project_id").distinct().join(found, "project_id", "left").na.fill(False, ["has_circular"])
    )


# fixed values: names an own function may not take
Builtins = (
    "count",
    "deps",
    "layers",
    "has_circular",
    "files",
    "ratio",
    "violations",
    "threshold",
    "all",
    "any",
    "filter",
    "map",
)


class Functions:
    """E15 ``expr_function``: named zero-argument sub-expressions.

    A name may not shadow a builtin, and since bodies are Python functions that
    call each other, a cycle is caught when a name is entered twice.
    """

    def __init__(self) -> None:
        self._bodies: dict[str, Callable[["Functions"], Column]] = {}
        self._open: list[str] = []

    def define(self, name: str, body: Callable[["Functions"], Column]) -> None:
        if name in Builtins:
            raise ValueError(f"{name!r} would shadow a builtin")
        self._bodies[name] = body

    def __call__(self, name: str) -> Column:
        if name not in self._bodies:
            raise KeyError(f"unknown function {name!r}")
        if name in self._open:
            raise ValueError(f"function cycle: {' -> '.join([*self._open, name])}")
        self._open.append(name)
        try:
            return self._bodies[name](self)
        finally:
            self._open.pop()


def expr_rule(metrics: DataFrame, rules: list[tuple[int, str, Column, str, str]]) -> DataFrame:
    """E16 ``expr_rule``: one violation per project and truthy rule, without file or layers.

    ``rules`` holds (ord, id, bad condition over the metric columns, severity, text).
    """
    hits = [
        F.when(
            bad,
            F.struct(
                F.lit(i).alias("rule_ord"),
                F.lit(id_).alias("rule_id"),
                F.lit(text or f"Expression check failed: {id_}").alias("message"),
                F.lit(severity).alias("severity"),
            ),
        )
        for i, id_, bad, severity, text in rules
    ]
    hit = metrics.select("project_id", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return hit.select(
        "project_id",
        "h.rule_ord",
        "h.rule_id",
        F.lit("").alias("file"),
        F.lit(0).alias("line"),
        F.lit("").alias("source_layer"),
        F.lit("").alias("target_layer"),
        F.lit("").alias("import_path"),
        "h.message",
        "h.severity",
        F.lit("").alias("original_severity"),
        F.lit(False).alias("overridden"),
    )
