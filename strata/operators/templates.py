"""Rule templates (R16-R18) and the template registry."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.model import VIOLATION_COLUMNS, Config, Layer, Rule
from strata.operators.layers import assign_source_layer

# --- fixed values: parameter types of the built-in templates -----------------
PARAMETERS = {
    "max-deps": {"from": "string", "to": "[]string", "max": "int"},
    "no-leak": {"layer": "string", "forbidden": "[]string"},
    "layer-balance": {"min": "int", "max": "int"},
}
# ----------------------------------------------------------------------------

Template = Callable[[DataFrame, tuple[Layer, ...], dict[str, Any], DataFrame], DataFrame]
COLUMNS = ("project_id", "file", "line", "source_layer", "target_layer", "import_path", "message")


def _blank(df: DataFrame, **given) -> DataFrame:
    base = {
        "file": F.lit(""),
        "line": F.lit(0),
        "source_layer": F.lit(""),
        "target_layer": F.lit(""),
        "import_path": F.lit(""),
    }
    return df.withColumns({**base, **given}).select(*COLUMNS)


def tpl_max_deps(edges: DataFrame, layers: tuple[Layer, ...], params: dict, projects: DataFrame) -> DataFrame:
    """R16 ``tpl_max_deps``: one violation when a layer has too many edges to the targets."""
    source, targets, most = params["from"], list(params["to"]), int(params["max"])
    counts = (
        edges.where((F.col("source_layer") == source) & F.col("resolved_layer").isin(*targets))
        .groupBy("project_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > most)
    )
    text = F.concat(
        F.lit(f"{source} has "),
        F.col("n").cast("string"),
        F.lit(f" dependencies to [{' '.join(targets)}] (max: {most})"),
    )
    return _blank(counts, message=text)


def tpl_no_leak(edges: DataFrame, layers: tuple[Layer, ...], params: dict, projects: DataFrame) -> DataFrame:
    """R17 ``tpl_no_leak``: one violation per edge from the layer into the forbidden set."""
    hits = edges.where(
        (F.col("source_layer") == params["layer"]) & F.col("resolved_layer").isin(*list(params["forbidden"]))
    )
    return hits.select(
        "project_id",
        F.col("source_file").alias("file"),
        F.col("source_line").alias("line"),
        "source_layer",
        F.col("resolved_layer").alias("target_layer"),
        "import_path",
        F.concat(
            F.col("source_file"),
            F.lit(" imports "),
            F.col("import_path"),
            F.lit(" from forbidden layer "),
            F.col("resolved_layer"),
        ).alias("message"),
    )


def tpl_layer_balance(edges: DataFrame, layers: tuple[Layer, ...], params: dict, projects: DataFrame) -> DataFrame:
    """R18 ``tpl_layer_balance``: outgoing edges per layer outside [min, max].

    Layers without any edge count as zero: the grid of projects x layers comes
    from the project list and the literal layers.
    """
    low, high = int(params["min"]), int(params["max"])
    grid = projects.select("project_id").distinct().select(
        "project_id", F.explode(F.array(*[F.lit(layer.name) for layer in layers])).alias("source_layer")
    )
    counts = (
        edges.where("source_layer is not null").groupBy("project_id", "source_layer").agg(F.count(F.lit(1)).alias("n"))
    )
    filled = grid.join(counts, ["project_id", "source_layer"], "left").na.fill(0, ["n"])
    lead = F.concat(F.col("source_layer"), F.lit(" has "), F.col("n").cast("string"), F.lit(" dependencies "))
    texts = F.array_compact(
        F.array(
            F.when(F.col("n") < low, F.concat(lead, F.lit(f"(min: {low})"))),
            F.when(F.col("n") > high, F.concat(lead, F.lit(f"(max: {high})"))),
        )
    )
    out = filled.select("project_id", "source_layer", F.explode(texts).alias("message"))
    return _blank(out, source_layer=F.col("source_layer"))


REGISTRY: dict[str, Template] = {
    "max-deps": tpl_max_deps,
    "no-leak": tpl_no_leak,
    "layer-balance": tpl_layer_balance,
}


def register_template(name: str, template: Template, parameters: dict[str, str]) -> None:
    """P2 ``register_template``: add a rule template with typed parameters."""
    if name in REGISTRY:
        raise ValueError(f"template {name!r} already exists")
    REGISTRY[name] = template
    PARAMETERS[name] = dict(parameters)


def check_parameters(name: str, params: dict[str, Any]) -> None:
    """Raise when a template's parameters are missing or of the wrong type."""
    if name not in PARAMETERS:
        raise ValueError(f"unknown template {name!r}")
    for key, kind in PARAMETERS[name].items():
        if key not in params:
            raise ValueError(f"template {name!r} needs parameter {key!r}")
        value = params[key]
        if kind == "string" and not isinstance(value, str):
            raise TypeError(f"{key}: expected string")
        if kind == "[]string" and not (
            isinstance(value, list | tuple) and all(isinstance(v, str) for v in value)
        ):
            raise TypeError(f"{key}: expected a list of strings")
        if kind == "int":
            whole = isinstance(value, int) and not isinstance(value, bool)
            whole = whole or (isinstance(value, float) and value == int(value))
            whole = whole or (isinstance(value, str) and value.lstrip("+-").isdigit())
            if not whole:
                raise TypeError(f"{key}: expected int")


def apply_template(edges: DataFrame, layers, ord_: int, rule: Rule, projects: DataFrame) -> DataFrame:
    """Run one template rule and shape its rows as violations."""
    check_parameters(rule.template, rule.params)
    rows = REGISTRY[rule.template](edges, layers, rule.params, projects)
    return rows.withColumns(
        {
            "rule_ord": F.lit(ord_),
            "rule_id": F.lit(rule.id),
            "severity": F.lit(rule.severity),
            "original_severity": F.lit(""),
            "overridden": F.lit(False),
        }
    ).select(*VIOLATION_COLUMNS)


def template_violations(deps: DataFrame, config: Config, projects: DataFrame) -> DataFrame | None:
    """All template rules of a config over (unfiltered) edges."""
    edges = assign_source_layer(deps, config.layers)
    out = None
    for i, rule in enumerate(config.rules, 1):
        if rule.template:
            rows = apply_template(edges, config.layers, i, rule, projects)
            out = rows if out is None else out.unionByName(rows)
    return out
