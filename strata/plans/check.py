"""End-to-end plans: check, audit and compare (R21 and the fleet report)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.model import Config, Layer
from strata.operators import diffs, graph, scoring
from strata.operators.corpus import filter_source_files, ignore_filter, ignored
from strata.operators.extraction import extract_imports
from strata.operators.metrics import expr_rule
from strata.operators.resolution import resolve_imports
from strata.operators.rules import classified, standard_violations
from strata.operators.templates import template_violations
from strata.session import materialise


def build_deps(
    files: DataFrame,
    layers: tuple[Layer, ...],
    aliases: dict[str, str] | None = None,
    ignore: list[str] = (),
    extensions: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """files -> deps: S5, S4, X0-X10, X13-X17, L3."""
    kept = ignore_filter(files, list(ignore))
    imports = extract_imports(filter_source_files(kept, extensions))
    return resolve_imports(imports, kept, layers, aliases).select(
        "project_id", "source_file", "source_line", "import_path", "resolved_layer", "language"
    )


def evaluate_rules(
    deps: DataFrame,
    config: Config,
    projects: DataFrame,
    metrics: DataFrame | None = None,
    checks: list[tuple[int, str, Column, str, str]] = (),
    stored: bool = False,
) -> DataFrame:
    """R21 ``evaluate_rules``: standard, expression, template and circular violations.

    ``metrics`` and ``checks`` feed the expression rules (E16); a rule of the config
    that has a ``check`` but no Column among ``checks`` is an error, so no rule is
    skipped in silence. Files that ``config.exclude`` matches take no part. The edges
    are read by every rule family, so they are written once first, unless they are
    ``stored``: a written table without excluded files.
    """
    given = {c[1] for c in checks} if metrics is not None else set()
    open_checks = sorted(r.id for r in config.rules if r.check and r.id not in given)
    if open_checks:
        raise ValueError(f"no metrics and check Column given for the rules {open_checks}")
    if not stored:
        deps = materialise(included(deps, config))
    out = standard_violations(deps, config)
    if metrics is not None and checks:
        out = out.unionByName(expr_rule(metrics, list(checks)))
    templated = template_violations(deps, config, projects)
    if templated is not None:
        out = out.unionByName(templated)
    pairs = graph.layer_edges(classified(deps, config.layers))
    return out.unionByName(graph.circular_violations(graph.layer_cycles(pairs), config))


def included(deps: DataFrame, config: Config) -> DataFrame:
    """Edges of the files that ``config.exclude`` leaves."""
    return deps.where(~ignored(F.col("source_file"), list(config.exclude))) if config.exclude else deps


def audit(
    deps: DataFrame,
    config: Config,
    projects: DataFrame,
    metrics: DataFrame | None = None,
    checks: list[tuple[int, str, Column, str, str]] = (),
) -> dict[str, DataFrame]:
    """Full health report of a fleet; edges and violations are written once and shared.

    Excluded files take no part in any of it. ``metrics`` and ``checks`` feed the config's
    expression rules, as in ``evaluate_rules``.
    """
    deps = materialise(included(deps, config))
    edges = classified(deps, config.layers)
    violations = materialise(evaluate_rules(deps, config, projects, metrics, checks, stored=True))
    coupling = scoring.coupling_matrix(edges)
    pairs = graph.pair_count(graph.bidirectional_pairs(coupling), projects)
    debt = scoring.debt_band(scoring.debt_score(violations, pairs))
    reports = scoring.project_report(violations, projects)
    return {
        "violations": violations,
        "coupling": scoring.coupling_band(scoring.coupling_pct(coupling)),
        "debt": debt,
        "layer_stats": scoring.layer_stats(coupling),
        "gate": scoring.gate(violations, projects, config.max_violations),
        "projects": reports,
        "fleet": scoring.workspace_report(reports),
    }


def compare_refs(violations: DataFrame, before: str, after: str) -> DataFrame:
    """Change rows between two values of the ``ref`` column of one evaluated table (H2)."""
    order = ["file", "line", "message"]
    old = violations.where(F.col("ref") == before).drop("ref")
    new = violations.where(F.col("ref") == after).drop("ref")
    return diffs.diff_runs(old, new, order)
