"""R22 over whole configurations: rules, layers, templates, functions, plugins and mappings as tables.

Everything here is configuration. Findings are rows (project_id, subject, finding); every
check is a projection or a join on names, so a fleet's tables are checked in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.languages import PROFILES
from strata.operators import graph
from strata.operators.metrics import Builtins
from strata.operators.rules import lint_rules
from strata.operators.templates import PARAMETERS

# --- fixed values -----------------------------------------------------------
PLUGIN_NAME = "^[a-zA-Z][a-zA-Z0-9_-]*$"
IDENTIFIER = r"^[\p{L}_][\p{L}\p{Nd}_]*$"
DURATION = r"^[+-]?(0|([0-9]+(\.[0-9]*)?|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)(([0-9]+(\.[0-9]*)?|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h))*)$"
STRATEGIES = ("", "stem", "glob")
#: template parameters that name layers
LAYER_PARAMETERS = {"max-deps": ("from", "to"), "no-leak": ("layer", "forbidden")}
# ----------------------------------------------------------------------------

_SHAPE = ["project_id", "subject", "finding"]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value, F.lit("'"))


def _findings(table: DataFrame, subject: str, checks: list[tuple[Column, Column | str]]) -> DataFrame:
    """A row for every check that holds."""
    texts = [F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in checks]
    return table.select("project_id", F.col(subject).alias("subject"), F.explode(F.array_compact(F.array(*texts))).alias("finding"))


def _repeated(table: DataFrame, name: str, finding: str) -> DataFrame:
    counts = table.groupBy("project_id", F.col(name).alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1").select("project_id", "subject", F.lit(finding).alias("finding"))


def compiles(pattern: Column) -> Column:
    """Does a regular expression compile in the engine that will run it?"""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def lint_patterns(rules: DataFrame) -> DataFrame:
    """Import patterns that do not compile."""
    text = _text("pattern")
    return _findings(rules, "id", [((text != "") & ~compiles(text), F.concat(F.lit("invalid pattern "), _quoted(text)))])


def lint_checks(rules: DataFrame) -> DataFrame:
    """Expression rules stand alone: no from, to, template or pattern beside ``check``."""
    own = _text("check") != ""
    fields = [
        ("from", _text("from_layer") != ""), ("to", F.size(F.coalesce("to_layers", F.array().cast("array<string>"))) > 0),
        ("template", _text("template") != ""), ("pattern", _text("pattern") != ""),
    ]
    return _findings(rules, "id", [(own & c, f"'check' expression rules cannot have '{name}' field") for name, c in fields])


def _list(value: Column) -> Column:
    """A JSON list of strings, else null."""
    shaped = value.rlike(r'^\s*\[\s*(("([^"\\]|\\.)*"\s*,\s*)*"([^"\\]|\\.)*"\s*)?\]\s*$')
    return F.when(shaped, F.from_json(value, "array<string>"))


def lint_templates(rules: DataFrame, layers: DataFrame) -> DataFrame:
    """Unknown templates, missing or ill-typed parameters, parameters that name unknown layers.

    ``params`` maps names to texts; lists and numbers are JSON.
    """
    used = rules.where(_text("template") != "").withColumn("params", F.coalesce("params", F.create_map().cast("map<string,string>")))
    template = F.col("template")
    checks: list[tuple[Column, Column | str]] = [(~template.isin(*PARAMETERS), F.concat(F.lit("unknown template "), _quoted(template)))]
    typed = {"int": lambda v: v.rlike(r"^\s*[+-]?[0-9]+(\.0*)?\s*$"), "[]string": lambda v: _list(v).isNotNull()}
    for name, schema in PARAMETERS.items():
        for key, kind in schema.items():
            value = F.try_element_at("params", F.lit(key))
            checks.append(((template == name) & value.isNull(), f"missing required param '{key}' for template '{name}'"))
            if kind in typed:
                checks.append(((template == name) & value.isNotNull() & ~typed[kind](value), f"param '{key}' for template '{name}': expected {kind}"))
    refs = []
    for name, keys in LAYER_PARAMETERS.items():
        for key in keys:
            value = F.try_element_at("params", F.lit(key))
            names = F.coalesce(_list(value), F.array(value)) if PARAMETERS[name][key] == "[]string" else F.array(value)
            labels = F.array_repeat(F.lit(key), F.size(names))
            named = F.arrays_zip(labels.alias("key"), names.alias("layer"))
            refs.append(F.when((template == name) & value.isNotNull(), named).otherwise(F.array().cast("array<struct<key:string,layer:string>>")))
    named = used.select("project_id", F.col("id").alias("subject"), F.inline(F.concat(*refs)))
    known = layers.select("project_id", F.col("name").alias("layer")).distinct()
    unknown = named.join(known, ["project_id", "layer"], "left_anti").select(
        "project_id", "subject", F.concat(F.lit("template param '"), "key", F.lit("' references unknown layer "), "layer").alias("finding")
    )
    return _findings(used, "id", checks).unionByName(unknown)


def lint_layers(rules: DataFrame, layers: DataFrame) -> DataFrame:
    """Layers without a name, and projects with rules and no layer."""
    bare = rules.select("project_id").distinct().join(layers.select("project_id").distinct(), "project_id", "left_anti")
    none = bare.select("project_id", F.lit("").alias("subject"), F.lit("at least one layer must be defined").alias("finding"))
    return none.unionByName(_findings(layers, "name", [(_text("name") == "", "layer name is required")]))


def lint_settings(settings: DataFrame) -> DataFrame:
    """``settings`` (project_id, max_violations, severity_map): a negative threshold, unknown severities."""
    allowed = F.col("max_violations")
    first = _findings(
        settings.withColumn("subject", F.lit("max_violations")), "subject",
        [(allowed < 0, F.concat(F.lit("max_violations cannot be negative (got "), allowed.cast("string"), F.lit(")")))],
    )
    pairs = settings.select("project_id", F.explode("severity_map").alias("subject", "to"))
    bad = [((~F.col("to").isin("error", "warning", "info")), F.concat(F.lit("severity map target "), _quoted(F.col("to")), F.lit(" is invalid")))]
    return first.unionByName(_findings(pairs, "subject", bad))


def lint_functions(functions: DataFrame) -> DataFrame:
    """``functions`` (project_id, name, calls): bad and builtin names, and cycles of calls.

    Calls of builtins and of names that the project doesn't define are no edges.
    """
    name = _text("name")
    checks = [
        (~name.rlike(IDENTIFIER), "invalid identifier"),
        (name.isin(*sorted(Builtins)), F.concat(F.lit("cannot shadow builtin "), _quoted(name))),
    ]
    known = functions.select("project_id", F.col("name").alias("target_layer")).distinct()
    calls = functions.select("project_id", F.col("name").alias("source_layer"), F.explode("calls").alias("target_layer"))
    edges = calls.distinct().join(known, ["project_id", "target_layer"]).withColumns({"file": F.lit(""), "line": F.lit(0)})
    cycles = graph.layer_cycles(edges).select(
        "project_id",
        F.element_at("cycle", 1).alias("subject"),
        F.concat(F.lit("circular reference: "), F.array_join("cycle", " -> ")).alias("finding"),
    )
    return _findings(functions, "name", checks).unionByName(cycles)


def lint_plugins(plugins: DataFrame) -> DataFrame:
    """``plugins`` (project_id, name, command, languages, timeout)."""
    name = _text("name")
    languages = F.coalesce("languages", F.array().cast("array<string>"))
    checks = [
        (name == "", "plugin name is required"),
        ((name != "") & ~name.rlike(PLUGIN_NAME), f"plugin name must match {PLUGIN_NAME}"),
        (name.isin(*sorted(PROFILES)), "plugin name conflicts with a built-in detector"),
        (_text("command") == "", "command is required"),
        (F.size(languages) == 0, "at least one language must be specified"),
        ((_text("timeout") != "") & ~_text("timeout").rlike(DURATION), F.concat(F.lit("invalid timeout "), _quoted(_text("timeout")))),
    ]
    return _findings(plugins, "name", checks).unionByName(_repeated(plugins, "name", "duplicate plugin name"))


def lint_mappings(mappings: DataFrame) -> DataFrame:
    """``mappings`` (project_id, ord, source_glob, generated_glob, language, strategy) between languages."""
    numbered = mappings.withColumn("subject", F.concat(F.lit("mapping "), F.col("ord").cast("string")))
    checks: list[tuple[Column, Column | str]] = [
        (_text(field) == "", f"{label} is required")
        for field, label in (("source_glob", "source pattern"), ("generated_glob", "generated pattern"), ("language", "language"))
    ]
    checks.append((~_text("strategy").isin(*STRATEGIES), "match strategy must be 'stem' or 'glob'"))
    return _findings(numbered, "subject", checks)


def lint_config(
    rules: DataFrame,
    layers: DataFrame,
    settings: DataFrame | None = None,
    functions: DataFrame | None = None,
    plugins: DataFrame | None = None,
    mappings: DataFrame | None = None,
) -> DataFrame:
    """R22 ``lint_rules`` for all parts of the configurations of a fleet.

    ``rules`` may have a ``check`` column (the expression as text) and ``params``; rules
    with a check are not asked for layers. Returns every finding, not the first one.
    """
    if "check" not in rules.columns:
        rules = rules.withColumn("check", F.lit(""))
    if "params" not in rules.columns:
        rules = rules.withColumn("params", F.lit(None).cast("map<string,string>"))
    lone = rules.where(_text("check") == "").drop("check")
    # a check rule has a type or none, and a severity; it names no layer
    checked = rules.where(_text("check") != "").drop("check").withColumn("template", F.lit("check"))
    found = [lint_rules(lone.unionByName(checked), layers), lint_layers(rules, layers), lint_patterns(rules), lint_checks(rules), lint_templates(rules, layers)]
    optional = ((settings, lint_settings), (functions, lint_functions), (plugins, lint_plugins), (mappings, lint_mappings))
    found += [check(table) for table, check in optional if table is not None]
    return reduce(DataFrame.unionByName, [f.select(*_SHAPE) for f in found])
