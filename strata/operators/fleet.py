"""A configuration per project: shared fields, fields of a project's own, and their evaluation.

Configurations are tables here, so nothing is compiled into the plan and any number of
projects can differ. Projects that set nothing themselves share one configuration key.
What depends on a file or an import alone is found once per distinct value and joined
back to the edges.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.model import LAYERS_SCHEMA, RULES_SCHEMA, VIOLATION_COLUMNS, Config
from strata.operators import graph
from strata.operators.pattern_index import compiled, first_layers, matching
from strata.operators.rules import FILE, IMPORT, circular_rules
from strata.session import materialise

SETTINGS_SCHEMA = "project_id string, exclude array<string>, max_violations int"
#: key of the shared configuration; a project's own key is its id behind a colon
SHARED = ""
_LAYER = "ord int, name string, paths array<string>"
_RULE = (
    "ord int, id string, from_layer string, to_layers array<string>, type string, severity string, explanation string, "
    "pattern string, exclude array<string>, overrides array<struct<path:string,severity:string,enabled:boolean>>, template string"
)
_VIOLATING = ("cannot", "mustnotcircular")


@dataclass(frozen=True)
class Fleet:
    """A shared configuration and what projects set themselves, as tables of the model's schemas.

    A project with layers of its own has only those, and likewise for rules and a
    non-empty exclude list; ``max_violations`` replaces the shared number where not null.
    """

    shared: Config
    layers: DataFrame | None = None
    rules: DataFrame | None = None
    settings: DataFrame | None = None

    def table(self, spark: SparkSession, which: str) -> DataFrame:
        schema = {"layers": LAYERS_SCHEMA, "rules": RULES_SCHEMA, "settings": SETTINGS_SCHEMA}[which]
        own = getattr(self, which)
        return spark.createDataFrame([], schema) if own is None else own


@dataclass(frozen=True)
class Merged:
    """L9 evaluated: ``keys`` (project_id, config) of the projects that differ, and tables by config."""

    keys: DataFrame
    layers: DataFrame
    rules: DataFrame
    excludes: DataFrame


def merge_configs(spark: SparkSession, fleet: Fleet) -> Merged:
    """L9 ``merge_config``: a field that a project sets replaces the shared field as a whole, else it is inherited."""
    layers, rules = fleet.table(spark, "layers"), fleet.table(spark, "rules")
    lists = fleet.table(spark, "settings").where("size(exclude) > 0")
    differ = layers.select("project_id").union(rules.select("project_id")).union(lists.select("project_id")).distinct()
    keys = materialise(differ.where("project_id is not null").withColumn("config", F.concat(F.lit(":"), "project_id")))
    both = keys.unionByName(spark.createDataFrame([(None, SHARED)], "project_id string, config string"))

    def field(own: DataFrame, shared: list[dict], schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        inherits = both.join(own.select("project_id").distinct(), "project_id", "left_anti")
        given = F.from_json(F.lit(json.dumps(shared)), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
        rows = own.join(keys, "project_id").select("config", *names).unionByName(inherits.select("config", F.inline(given)))
        # written, so that its size is known where it meets the edges
        return materialise(rows)

    shared = fleet.shared
    shared_layers = [{"ord": i, "name": y.name, "paths": list(y.paths)} for i, y in enumerate(shared.layers, 1)]
    shared_rules = [
        {
            "ord": i, "id": r.id, "from_layer": r.from_layer, "to_layers": list(r.to_layers), "type": r.type, "severity": r.severity,
            "explanation": r.explanation, "pattern": r.pattern, "exclude": list(r.exclude),
            "overrides": [{"path": o.path, "severity": o.severity, "enabled": o.enabled} for o in r.overrides],
            # a check is a Column of the caller's and no part of a table
            "template": r.template or ("check" if r.check is not None else ""),
        }
        for i, r in enumerate(shared.rules, 1)
    ]
    return Merged(
        keys,
        field(layers, shared_layers, _LAYER),
        field(rules, shared_rules, _RULE),
        field(lists.select("project_id", F.explode("exclude").alias("glob")), [{"glob": g} for g in shared.exclude], "glob string"),
    )


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _file_patterns(config: Merged) -> DataFrame:
    """Everything a configuration says about files: (config, use, ord, pos, value, size) and the compiled glob."""
    none = F.lit(None).cast("string")
    layers = config.layers.select(
        "config", F.lit("layer").alias("use"), "ord", F.posexplode("paths").alias("pos", "glob"), F.col("name").alias("value"), F.lit("layer").alias("dialect")
    )
    drops = config.excludes.select(
        "config", F.lit("drop").alias("use"), F.lit(0).alias("ord"), F.lit(0).alias("pos"), "glob", none.alias("value"), F.lit("ignore").alias("dialect")
    )
    excludes = config.rules.select(
        "config", F.lit("off").alias("use"), "ord", F.posexplode("exclude").alias("pos", "glob"), none.alias("value"), F.lit("exclude").alias("dialect")
    )
    globs = compiled(layers.unionByName(drops).unionByName(excludes)).drop("glob", "dialect")
    # an override path covers itself and what lies below, with a slash behind only the latter
    overrides = config.rules.select("config", "ord", F.posexplode("overrides").alias("pos", "o")).select(
        "config", "ord", "pos", F.coalesce("o.path", F.lit("")).alias("path"), F.col("o.severity").alias("severity"), F.col("o.enabled").alias("enabled")
    )
    folder = F.col("path").endswith("/")
    at = F.when(folder, F.expr("substring(path, 1, length(path) - 1)")).otherwise(F.col("path"))
    covering = overrides.withColumn("anchor", F.when(F.col("path") == "/", F.lit("")).otherwise(at)).select(
        "config", "ord", "pos", "anchor", "severity", "enabled",
        F.when(folder, F.lit("prefix")).otherwise(F.lit("subtree")).alias("kind"), F.col("path").alias("head"), F.lit("").alias("rx"), F.length("path").alias("size"),
    )
    shape = ["config", "use", "ord", "pos", "value", "size", "anchor", "kind", "head", "rx"]
    off = covering.where("enabled = false").select("*", F.lit("off").alias("use"), none.alias("value"))
    severity = covering.where("severity <> ''").select("*", F.lit("severity").alias("use"), F.col("severity").alias("value"))
    return globs.withColumn("size", F.lit(0)).select(*shape).unionByName(off.select(*shape)).unionByName(severity.select(*shape))


def _file_facts(files: DataFrame, config: Merged) -> DataFrame:
    """Per (config, path) that anything matches: layer, dropped, rules switched off, severities in force."""
    hits = matching(files, _file_patterns(config))
    use = F.col("use")
    change = F.struct("ord", "size", (-F.col("pos")).alias("first"), F.col("value").alias("severity"))
    return hits.groupBy("config", "path").agg(
        F.min_by("value", F.when(use == "layer", F.struct("ord", "pos"))).alias("source_layer"),
        F.max(use == "drop").alias("dropped"),
        F.collect_set(F.when(use == "off", F.col("ord"))).alias("off"),
        F.collect_list(F.when(use == "severity", change)).alias("changes"),
    )


def _keyed(table: DataFrame, config: Merged) -> DataFrame:
    return table.join(config.keys, "project_id", "left").withColumn("config", F.coalesce("config", F.lit(SHARED)))


def classified_by_project(deps: DataFrame, config: Merged, target: str | None = IMPORT) -> DataFrame:
    """L2, L3 and excludes by each project's configuration; edges without a layer on either side go.

    Patterns run on distinct files and imports only, those of rules too (``by_pattern`` and
    ``if_layer`` hold their numbers), so the edges meet each side once. ``target`` is the
    column whose globs give the imported layer; None keeps ``resolved_layer`` as it is.
    ``deps`` is read three times: a written table spares its plan.
    """
    edges = _keyed(deps, config)
    facts = _file_facts(edges.select("config", F.col(FILE).alias("path")).distinct(), config)
    facts = facts.where("source_layer is not null and not dropped").drop("dropped").withColumnRenamed("path", FILE)
    texts = _import_texts(edges.select("config", IMPORT).distinct(), config)
    if target is not None:
        layers = first_layers(edges.select("config", F.col(target).alias("path")).distinct(), config.layers)
        layers = layers.select("config", F.col("path").alias(target), F.col("layer").alias("resolved_layer"))
        edges = edges.drop("resolved_layer")
        if target == IMPORT:
            edges = edges.join(layers.join(texts, ["config", IMPORT], "left"), ["config", IMPORT])
        else:
            edges = edges.join(layers, ["config", target])
    if target != IMPORT:
        edges = edges.join(texts, ["config", IMPORT], "left")
    return edges.where("resolved_layer is not null").join(facts, ["config", FILE])


def _violating(config: Merged) -> DataFrame:
    return config.rules.where(F.lower(_text("type")).isin(*_VIOLATING) & (_text("template") == ""))


def _import_texts(imports: DataFrame, config: Merged) -> DataFrame:
    """Per (config, import) that a rule's pattern matches: numbers of the rules without and with layers."""
    layered = _text("from_layer") != ""
    texts = _violating(config).where(_text("pattern") != "").select("config", "ord", "pattern", layered.alias("and_layer"))
    return imports.join(texts, "config").where(F.regexp_like(IMPORT, F.col("pattern"))).groupBy("config", IMPORT).agg(
        F.collect_set(F.when(~F.col("and_layer"), F.col("ord"))).alias("by_pattern"),
        F.collect_set(F.when(F.col("and_layer"), F.col("ord"))).alias("if_layer"),
    )


def _broken(edges: DataFrame, config: Merged) -> DataFrame:
    """Edges with the number of each violating rule they fall under, off rules aside."""
    rules = _violating(config)
    layered, pattern = _text("from_layer") != "", _text("pattern") != ""
    ends = rules.where(layered).select("config", F.col("from_layer").alias("source_layer"), F.explode("to_layers").alias("resolved_layer"), "ord", pattern.alias("and_pattern"))
    ends = ends.groupBy("config", "source_layer", "resolved_layer").agg(
        F.collect_set(F.when(~F.col("and_pattern"), F.col("ord"))).alias("by_layer"),
        F.collect_set(F.when(F.col("and_pattern"), F.col("ord"))).alias("if_pattern"),
    )
    none = F.array().cast("array<int>")
    ords = F.concat(
        F.coalesce("by_layer", none),
        F.coalesce("by_pattern", none),
        F.array_intersect(F.coalesce("if_pattern", none), F.coalesce("if_layer", none)),
    )
    joined = edges.join(ends, ["config", "source_layer", "resolved_layer"], "left")
    return joined.withColumn("rule_ord", F.explode(F.array_except(ords, "off")))


def standard_violations_by_project(edges: DataFrame, config: Merged) -> DataFrame:
    """R1, R4-R6 with R8-R10 and R12 over ``classified_by_project`` edges."""
    named = config.rules.select("config", F.col("ord").alias("rule_ord"), F.col("id").alias("rule_id"), _text("severity").alias("base"), _text("explanation").alias("why"))
    hits = _broken(edges, config).join(named, ["config", "rule_ord"])
    changed = F.array_max(F.filter("changes", lambda c: c["ord"] == F.col("rule_ord")))["severity"]
    source, layer = F.col("source_layer"), F.col("resolved_layer")
    plain = F.concat(source, F.lit(" cannot depend on "), layer, F.lit(" (import: "), F.col(IMPORT), F.lit(")"))
    told = F.concat("why", F.lit(": "), source, F.lit(" cannot import "), layer)
    return hits.select(
        "project_id",
        "rule_ord",
        "rule_id",
        F.col(FILE).alias("file"),
        F.col("source_line").alias("line"),
        "source_layer",
        layer.alias("target_layer"),
        IMPORT,
        F.when(F.col("why") == "", plain).otherwise(told).alias("message"),
        F.coalesce(changed, "base").alias("severity"),
        F.when(changed.isNotNull(), F.col("base")).otherwise("").alias("original_severity"),
        changed.isNotNull().alias("overridden"),
    ).select(*VIOLATION_COLUMNS)


def missing_edges_by_project(edges: DataFrame, config: Merged, projects: DataFrame) -> DataFrame:
    """R2 by project: one row per project and Must rule whose edge is absent."""
    due = _keyed(projects.select("project_id").distinct(), config).join(
        config.rules.where((F.lower(_text("type")) == "must") & (_text("from_layer") != "") & (_text("template") == "")), "config"
    )
    seen = edges.select("project_id", "source_layer", "resolved_layer", IMPORT)
    met = due.select("project_id", F.col("ord"), F.col("from_layer").alias("source_layer"), F.explode("to_layers").alias("resolved_layer"), _text("pattern").alias("pattern"))
    met = seen.join(met, ["project_id", "source_layer", "resolved_layer"]).where((F.col("pattern") == "") | F.regexp_like(IMPORT, F.col("pattern")))
    open_ = due.join(met.select("project_id", "ord").distinct(), ["project_id", "ord"], "left_anti")
    message = F.concat("from_layer", F.lit(" must depend on "), F.array_join("to_layers", ", "))
    return open_.select("project_id", F.col("ord").alias("rule_ord"), F.col("id").alias("rule_id"), F.col("from_layer").alias("source_layer"), "severity", message.alias("message"))


def _circular_rules_of(projects: DataFrame, config: Merged) -> DataFrame:
    """Circular rules of each project; one without any has the built-in rule."""
    own = config.rules.where((F.lower(_text("type")) == "mustnotcircular") & (_text("template") == "")).select(
        "config", F.col("ord").alias("rule_ord"), F.col("id").alias("rule_id"), _text("from_layer").alias("from_layer"), "to_layers", "severity"
    )
    keyed = _keyed(projects.select("project_id").distinct(), config)
    ((ord_, rule),) = circular_rules(Config(()))
    built_in = keyed.join(own.select("config").distinct(), "config", "left_anti").select(
        "project_id", F.lit(ord_).alias("rule_ord"), F.lit(rule.id).alias("rule_id"), F.lit(rule.from_layer).alias("from_layer"),
        F.array(*[F.lit(t) for t in rule.to_layers]).alias("to_layers"), F.lit(rule.severity).alias("severity"),
    )
    return keyed.join(own, "config").drop("config").unionByName(built_in)


def evaluate_fleet(deps: DataFrame, fleet: Fleet, projects: DataFrame, target: str | None = IMPORT) -> DataFrame:
    """R21 over a fleet whose projects have configurations of their own: standard and circular violations.

    The classified edges are written once, since both families read them. Template and
    expression rules hold Columns of the caller and are no part of a table; they are
    evaluated by ``plans.check.evaluate_rules``.
    """
    config = merge_configs(deps.sparkSession, fleet)
    # no rule asks for the language, so it need not travel
    edges = materialise(classified_by_project(deps.drop("language"), config, target))
    cycles = graph.layer_cycles(graph.layer_edges(edges))
    circular = graph.circular_violations_by_table(cycles, _circular_rules_of(projects, config))
    return standard_violations_by_project(edges, config).unionByName(circular)


def gate_by_project(violations: DataFrame, fleet: Fleet, projects: DataFrame) -> DataFrame:
    """G15 with each project's own ``max_violations``; overridden rows do not count."""
    own = fleet.table(violations.sparkSession, "settings").where("max_violations is not null")
    counts = violations.where("not overridden").groupBy("project_id").agg(F.count(F.lit(1)).alias("counted"))
    return (
        projects.select("project_id")
        .distinct()
        .join(counts, "project_id", "left")
        .join(own.select("project_id", "max_violations"), "project_id", "left")
        .withColumn("counted", F.coalesce("counted", F.lit(0)))
        .withColumn("allowed", F.greatest(F.coalesce("max_violations", F.lit(fleet.shared.max_violations)), F.lit(0)))
        .select("project_id", "counted", "allowed", (F.col("counted") <= F.col("allowed")).alias("passed"))
    )
