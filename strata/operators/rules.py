"""Rule evaluation.

Rules are configuration, so every condition of every rule is a literal Column.
Evaluating a rule set is then one narrow stage over the edges: compute the
array of rules each edge breaks, explode it. Nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.globs import any_of, glob_match
from strata.model import (
    RULE_TYPES,
    SEVERITIES,
    VIOLATION_COLUMNS,
    Config,
    Layer,
    Rule,
    fold_rule_type,
)
from strata.operators.layers import assign_source_layer
from strata.operators.ordered import numbered
from strata.session import materialise

FILE, IMPORT = "source_file", "import_path"


def covers(path: str, file: Column) -> Column:
    """Does an override path cover a file? '' covers everything."""
    if path == "":
        return F.lit(True)
    if path.endswith("/"):
        return file.startswith(path)
    return (file == path) | file.startswith(path + "/")


def skip_unresolved(edges: DataFrame) -> DataFrame:
    """R7 ``skip_unresolved``: drop edges with a missing layer on either side."""
    return edges.where(F.col("source_layer").isNotNull() & F.col("resolved_layer").isNotNull())


def classified(deps: DataFrame, layers: tuple[Layer, ...]) -> DataFrame:
    """L2 then R7."""
    return skip_unresolved(assign_source_layer(deps, layers))


def rule_matches(rule: Rule) -> Column:
    """Does an edge fall under a rule (type aside)? R1, R5 and R6 share this.

    ``from`` + ``to`` match layers, ``pattern`` matches the import path; a rule
    with only a pattern matches any layer pair.
    """
    parts = []
    if rule.from_layer:
        parts.append((F.col("source_layer") == rule.from_layer) & F.col("resolved_layer").isin(*rule.to_layers))
    if rule.pattern:
        parts.append(F.col(IMPORT).rlike(rule.pattern))
    if not parts:
        return F.lit(False)
    out = parts[0]
    for part in parts[1:]:
        out = out & part
    return out


def override_disable(rule: Rule, file: Column) -> Column:
    """R8 ``override_disable``: is the rule switched off for this file?"""
    return any_of([covers(o.path, file) for o in rule.overrides if o.enabled is False])


def rule_exclude(rule: Rule, file: Column) -> Column:
    """R9 ``rule_exclude``: is this file excluded from the rule?"""
    return any_of([glob_match(file, g, "exclude") for g in rule.exclude])


def override_severity(rule: Rule, file: Column) -> Column:
    """R10 ``override_severity``: severity of the longest covering path, else NULL.

    Ties keep the first listed override.
    """
    ranked = sorted((o for o in rule.overrides if o.severity), key=lambda o: -len(o.path))
    if not ranked:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(covers(o.path, file), F.lit(o.severity)) for o in ranked])


def violation_message(rule: Rule) -> Column:
    """R12 ``violation_message``."""
    source, target = F.col("source_layer"), F.col("resolved_layer")
    if rule.explanation:
        return F.concat(F.lit(rule.explanation + ": "), source, F.lit(" cannot import "), target)
    return F.concat(source, F.lit(" cannot depend on "), target, F.lit(" (import: "), F.col(IMPORT), F.lit(")"))


def _hit(ord_: int, rule: Rule) -> Column:
    changed = override_severity(rule, F.col(FILE))
    return F.struct(
        F.lit(ord_).alias("rule_ord"),
        F.lit(rule.id).alias("rule_id"),
        violation_message(rule).alias("message"),
        F.coalesce(changed, F.lit(rule.severity)).alias("severity"),
        F.when(changed.isNotNull(), F.lit(rule.severity)).otherwise("").alias("original_severity"),
        changed.isNotNull().alias("overridden"),
    )


def apply_rules(edges: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Violations of the given (ord, rule) pairs over classified edges.

    Per rule the order is: match, disable, exclude, severity.
    """
    file = F.col(FILE)
    hits = [
        F.when(rule_matches(r) & ~override_disable(r, file) & ~rule_exclude(r, file), _hit(i, r)) for i, r in rules
    ]
    if not hits:
        hits = [F.when(F.lit(False), _hit(0, Rule("none")))]
    return (
        edges.withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
        .select(
            "project_id",
            "_hit.rule_ord",
            "_hit.rule_id",
            F.col(FILE).alias("file"),
            F.col("source_line").alias("line"),
            "source_layer",
            F.col("resolved_layer").alias("target_layer"),
            IMPORT,
            "_hit.message",
            "_hit.severity",
            "_hit.original_severity",
            "_hit.overridden",
        )
        .select(*VIOLATION_COLUMNS)
    )


def numbered_rules(rules: tuple[Rule, ...]) -> list[tuple[int, Rule]]:
    return list(enumerate(rules, 1))


def standard_violations(deps: DataFrame, config: Config) -> DataFrame:
    """R1, R4, R5, R6 with R7-R10 and R12 applied: the per-edge rules of a config."""
    rules = [(i, r) for i, r in numbered_rules(config.rules) if r.violates and not r.template and r.check is None]
    return apply_rules(classified(deps, config.layers), rules)


def rules_of_type(config: Config, kind: str) -> list[tuple[int, Rule]]:
    return [(i, r) for i, r in numbered_rules(config.rules) if fold_rule_type(r.type) == kind and not r.template]


def rule_cannot(deps: DataFrame, config: Config) -> DataFrame:
    """R1 ``rule_cannot``: edges that exist although they may not (layer rules)."""
    rules = [(i, r) for i, r in rules_of_type(config, "Cannot") if r.from_layer and not r.pattern]
    return apply_rules(classified(deps, config.layers), rules)


def rule_must(deps: DataFrame, config: Config, projects: DataFrame, compat: bool = False) -> DataFrame:
    """R2 ``rule_must``: one violation per project and rule whose edge is absent.

    Starts from the project list, so a project without any edge still reports.
    Only distinct (project, source, target) triples of the rules' layers are
    joined. ``compat=True`` never violates.
    """
    wanted = [] if compat else [(i, r) for i, r in rules_of_type(config, "Must") if r.from_layer]
    if not wanted:
        return projects.where(F.lit(False)).selectExpr(
            "project_id", "0 as rule_ord", "'' as rule_id", "'' as source_layer", "'' as severity", "'' as message"
        )
    options = [
        F.struct(
            F.lit(i).alias("rule_ord"),
            F.lit(r.id).alias("rule_id"),
            F.lit(r.from_layer).alias("source_layer"),
            F.lit(r.severity).alias("severity"),
            F.lit(f"{r.from_layer} must depend on {', '.join(r.to_layers)}").alias("message"),
        )
        for i, r in wanted
    ]
    due = (
        projects.select("project_id")
        .distinct()
        .select("project_id", F.explode(F.array(*options)).alias("r"))
        .select("project_id", "r.*")
    )
    met = F.array_compact(F.array(*[F.when(rule_matches(r), F.lit(i)) for i, r in wanted]))
    seen = classified(deps, config.layers).select("project_id", F.explode(met).alias("rule_ord")).distinct()
    return due.join(seen, ["project_id", "rule_ord"], "left_anti")


def rule_can(deps: DataFrame, config: Config) -> DataFrame:
    """R3 ``rule_can``: edges an informational rule describes; never violations."""
    rules = rules_of_type(config, "Can")
    return apply_rules(classified(deps, config.layers), rules).withColumn("is_violation", F.lit(False))


def rule_must_not_circular_edge(deps: DataFrame, config: Config) -> DataFrame:
    """Any edge a MustNotCircular rule names is a violation."""
    rules = [(i, r) for i, r in rules_of_type(config, "MustNotCircular") if r.from_layer and not r.pattern]
    return apply_rules(classified(deps, config.layers), rules)


def rule_pattern(deps: DataFrame, config: Config) -> DataFrame:
    """R5 ``rule_pattern``: import-path regex without layers."""
    rules = [(i, r) for i, r in numbered_rules(config.rules) if r.pattern and not r.from_layer and r.violates]
    return apply_rules(classified(deps, config.layers), rules)


def rule_pattern_layers(deps: DataFrame, config: Config) -> DataFrame:
    """R6 ``rule_pattern_layers``: import-path regex and a layer pair."""
    rules = [(i, r) for i, r in numbered_rules(config.rules) if r.pattern and r.from_layer and r.violates]
    return apply_rules(classified(deps, config.layers), rules)


def severity_map(rules: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """R11 ``severity_map``: rewrite severities of rules and their overrides."""
    bad = {k: v for k, v in mapping.items() if v not in SEVERITIES}
    if bad:
        raise ValueError(f"severity map targets must be one of {SEVERITIES}: {bad}")

    def mapped(value: Column) -> Column:
        out = value
        for source, target in mapping.items():
            out = F.when(value == source, F.lit(target)).otherwise(out)
        return out

    return rules.withColumns(
        {
            "severity": mapped(F.col("severity")),
            "overrides": F.transform(
                "overrides",
                lambda o: F.struct(
                    o["path"].alias("path"), mapped(o["severity"]).alias("severity"), o["enabled"].alias("enabled")
                ),
            ),
        }
    )


def violation_ids(violations: DataFrame, prefix: str = "D") -> DataFrame:
    """R15 ``violation_ids``: sequential ids per project in evaluation order."""
    order = ["rule_ord", "file", "line", "import_path", "source_layer", "target_layer", "message", "severity"]
    ranked = numbered(violations, ["project_id"], order, "_n")
    digits = F.lpad(F.col("_n").cast("string"), 2, "0")
    number = F.when(F.col("_n") < 100, digits).otherwise(F.col("_n").cast("string"))
    return ranked.withColumn("id", F.concat(F.lit(prefix + "-"), number)).drop("_n")


def circular_rules(config: Config) -> list[tuple[int, Rule]]:
    """Circular rules of a config, or the built-in one when it has none."""
    found = rules_of_type(config, "MustNotCircular")
    default = Rule(
        "no-circular-dependencies",
        "*",
        ("*",),
        "MustNotCircular",
        "error",
        "Circular dependencies create tightly coupled code that is hard to test, modify, and deploy.",
    )
    return found or [(0, default)]


# --- policies ---------------------------------------------------------------

Policy = Callable[[DataFrame, tuple[Layer, ...], DataFrame, dict], DataFrame]


def policy_udf(
    policy: Policy, rule: Rule, deps: DataFrame, config: Config, violations: DataFrame
) -> tuple[DataFrame | None, str]:
    """R19 ``policy_udf``: run a user policy given as a DataFrame -> DataFrame function.

    The policy returns (project_id, message[, file, severity, rule_id]). A rule
    disabled everywhere is skipped; disabled or excluded files are dropped. The
    policy's rows are written here, so that one that cannot be planned or fails while
    it runs is reported in the status and never takes the others along.
    """
    if any(o.enabled is False and o.path == "" for o in rule.overrides):
        return None, "disabled"
    try:
        found = policy(deps, config.layers, violations, rule.params)
        for name, default in (("file", ""), ("severity", ""), ("rule_id", "")):
            if name not in found.columns:
                found = found.withColumn(name, F.lit(default))
        file = F.col("file")
        kept = found.where(~override_disable(rule, file) & ~rule_exclude(rule, file))
        filled = kept.select(
            "project_id",
            F.when(F.col("rule_id") == "", F.lit(rule.id)).otherwise(F.col("rule_id")).alias("rule_id"),
            "file",
            "message",
            F.when(F.col("severity") == "", F.lit(rule.severity)).otherwise(F.col("severity")).alias("severity"),
        )
        return materialise(filled), "ok"
    except Exception as error:  # a faulty policy must not stop the others
        return None, f"error: {type(error).__name__}"


def project_counts(deps: DataFrame, violations: DataFrame, projects: DataFrame) -> DataFrame:
    """Edges and violations per project, zero when there are none."""
    n_deps = deps.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_deps"))
    n_viol = violations.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_violations"))
    return (
        projects.select("project_id")
        .distinct()
        .join(n_deps, "project_id", "left")
        .join(n_viol, "project_id", "left")
        .na.fill(0, ["n_deps", "n_violations"])
    )


def policy_symmetry(counts: DataFrame) -> DataFrame:
    """Violations without any dependency."""
    return counts.where("n_violations > 0 and n_deps = 0").select(
        "project_id", F.lit("dependency-symmetry: violations with no deps indicates asymmetry").alias("message")
    )


def policy_balance(counts: DataFrame, n_layers: int, factor: int = 10) -> DataFrame:
    """More dependencies than ``factor`` per layer."""
    return counts.where((F.lit(n_layers) > 0) & (F.col("n_deps") > n_layers * factor)).select(
        "project_id", F.lit("layer-balance: deps/layer ratio too high").alias("message")
    )


def policy_leak(counts: DataFrame) -> DataFrame:
    """Dependencies but no violation at all."""
    return counts.where("n_deps > 0 and n_violations = 0").select(
        "project_id",
        F.lit("no-leak: deps exist without any violations — potential leak").alias("message"),
    )


# --- linting ----------------------------------------------------------------


def lint_rules(rules: DataFrame, layers: DataFrame) -> DataFrame:
    """R22 ``lint_rules``: referential and shape checks of rule and layer tables.

    Returns (project_id, subject, finding). Both tables are configuration;
    checks within one rule are literal, only name lookups join.
    """
    known = layers.select("project_id", F.col("name").alias("layer")).distinct()
    refs = rules.select(
        "project_id",
        F.col("id").alias("subject"),
        F.explode(
            F.concat(
                F.when(F.col("from_layer") != "", F.array(F.struct(F.lit("from").alias("side"), F.col("from_layer").alias("layer")))).otherwise(
                    F.array().cast("array<struct<side:string,layer:string>>")
                ),
                F.transform("to_layers", lambda t: F.struct(F.lit("to").alias("side"), t.alias("layer"))),
            )
        ).alias("ref"),
    ).select("project_id", "subject", "ref.side", "ref.layer")
    unknown = refs.join(known, ["project_id", "layer"], "left_anti").select(
        "project_id",
        "subject",
        F.concat(F.lit("'"), F.col("side"), F.lit("' references unknown layer "), F.col("layer")).alias("finding"),
    )
    repeated = (
        layers.groupBy("project_id", F.col("name").alias("subject"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("project_id", "subject", F.lit("duplicate layer name").alias("finding"))
    )
    bare = (F.col("from_layer") == "") & (F.size("to_layers") == 0)
    template_only = (F.col("template") != "") & bare & (F.col("pattern") == "")
    pattern_only = (F.col("pattern") != "") & bare
    bad_type = ~F.col("type").isin(*RULE_TYPES) & ~(template_only & (F.col("type") == ""))
    bad_severity = ~F.col("severity").isin(*SEVERITIES, "")
    bad_override = F.exists("overrides", lambda o: ~F.coalesce(o["severity"], F.lit("")).isin(*SEVERITIES, ""))
    plain = ~template_only & ~pattern_only
    checks = [
        (F.col("id") == "", "rule ID is required"),
        (bad_type, "invalid rule type"),
        (bad_severity, "invalid severity"),
        (plain & (F.col("from_layer") == ""), "'from' field is required"),
        (plain & (F.size("to_layers") == 0), "'to' field must have at least one target"),
        (plain & bad_override, "override has invalid severity"),
    ]
    shaped = rules.select(
        "project_id",
        F.col("id").alias("subject"),
        F.explode(F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in checks]))).alias("finding"),
    )
    empty = layers.where(F.size("paths") == 0).select(
        "project_id", F.col("name").alias("subject"), F.lit("layer must have at least one path pattern").alias("finding")
    )
    return unknown.unionByName(repeated).unionByName(shaped).unionByName(empty)
