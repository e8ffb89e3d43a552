"""Layer classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.globs import any_of, first_match, glob_match, glob_regex
from strata.functions.paths import ancestors
from strata.model import Layer
from strata.operators.pattern_index import first_layers

# --- fixed values -----------------------------------------------------------
# Directory conventions: layer -> candidate directories, in listed order.
CONVENTIONS = {
    "domain": ("internal/domain", "src/domain", "domain", "core", "entities"),
    "application": ("internal/application", "src/application", "application", "usecases", "services", "app"),
    "infrastructure": (
        "internal/infrastructure",
        "src/infrastructure",
        "infrastructure",
        "infra",
        "adapters",
        "persistence",
    ),
    "presentation": (
        "internal/presentation",
        "src/presentation",
        "presentation",
        "api",
        "handlers",
        "controllers",
        "cmd",
        "cli",
    ),
    "ports": ("internal/ports", "src/ports", "ports"),
}
# Default rules for layer pairs: (id, from, to, type, severity).
DEFAULT_RULES = (
    ("domain-imports-infrastructure", "domain", "infrastructure", "Cannot", "error"),
    ("domain-imports-application", "domain", "application", "Cannot", "error"),
    ("application-imports-infrastructure", "application", "infrastructure", "Cannot", "error"),
    ("presentation-imports-infrastructure", "presentation", "infrastructure", "Cannot", "warning"),
    ("presentation-imports-domain", "presentation", "domain", "Cannot", "warning"),
    ("application-imports-domain", "application", "domain", "Can", "info"),
    ("infrastructure-imports-domain", "infrastructure", "domain", "Can", "info"),
)
# ----------------------------------------------------------------------------


def assign_source_layer(deps: DataFrame, layers: tuple[Layer, ...]) -> DataFrame:
    """L2 ``assign_source_layer``: layer of the importing file, first match wins.

    The patterns are literal, so this is a projection: no join, no shuffle.
    """
    return deps.withColumn("source_layer", first_match(F.col("source_file"), layers))


def assign_source_layer_by_table(deps: DataFrame, layers: DataFrame, path: str = "source_file") -> DataFrame:
    """L2 for fleets whose projects bring their own layer tables.

    Distinct paths meet the globs of their project by the literal directories both have;
    the layers found join back to the edges.
    """
    keyed = deps.withColumn("config", F.col("project_id"))
    found = first_layers(keyed.select("config", F.col(path).alias("path")).distinct(), layers.withColumn("config", F.col("project_id")))
    found = found.select(F.col("config").alias("project_id"), F.col("path").alias(path), F.col("layer").alias("source_layer"))
    return deps.join(found, ["project_id", path], "left").select(*deps.columns, "source_layer")


def assign_target_layer(
    imports: DataFrame, layers: tuple[Layer, ...], target_path: str | None = "target_path"
) -> DataFrame:
    """L3 ``assign_target_layer``: layer of the imported thing.

    Reads ``norm`` (the normalised import), ``import_path``, ``language`` and
    ``is_external``; writes ``resolved_layer``. Strategies are tried per
    language in rank order, layers in listed order, and the file found by
    candidate search (``target_path``) is the last resort.
    """
    norm, raw, lang = F.col("norm"), F.col("import_path"), F.col("language")
    # used by most branches, so it is a column of its own and is computed once
    imports = imports.withColumn("_by_glob", first_match(norm, layers))
    by_glob = F.col("_by_glob")
    by_suffix = _first(layers, lambda ly: any_of([norm.rlike(glob_regex(p, "suffix")) for p in ly.paths]))
    by_name = _first(layers, lambda ly: F.lower(raw) == ly.name.lower())
    scope = F.split(raw, "/")
    by_scope = _first(
        layers, lambda ly: (F.substring(scope[0], 2, 1 << 20) == ly.name) | (F.get(scope, F.lit(1)) == ly.name)
    )
    by_prefix = _first(layers, lambda ly: raw.startswith(ly.name) | raw.contains("/" + ly.name + "/"))
    relative = raw.startswith(".") | raw.startswith("/")
    typescript = F.when(relative, by_glob).otherwise(
        F.coalesce(F.when(raw.startswith("@") & (F.size(scope) >= 2), by_scope), by_prefix)
    )
    # relative Ruby and PHP imports may also be named from inside the source folder
    climbs = raw.startswith("./") | raw.startswith("../")
    inside = F.when((lang == "php") & norm.startswith("src/"), F.substring(norm, 5, 1 << 20)).when(
        (lang == "ruby") & norm.startswith("lib/"), F.substring(norm, 5, 1 << 20)
    )
    by_inside = F.when(climbs, first_match(inside, layers))
    choice = (
        F.when(F.coalesce(F.col("is_external"), F.lit(False)), F.lit(None))
        .when(lang == "typescript", F.when(F.coalesce(F.col("aliased"), F.lit(False)), by_glob).otherwise(typescript))
        .when(lang == "swift", F.coalesce(by_name, by_glob))
        .when(lang == "csharp", F.coalesce(by_glob, by_suffix))
        .when(lang.isin("php", "ruby"), F.coalesce(by_glob, by_inside))
        .otherwise(by_glob)
    )
    if target_path:
        at = F.col(target_path)
        below = F.when((lang == "swift") & at.startswith("Sources/"), F.substring(at, 9, 1 << 20))
        located = F.coalesce(first_match(at, layers), first_match(below, layers))
        found = F.when(~F.coalesce(F.col("is_external"), F.lit(False)), located)
        choice = F.coalesce(choice, found)
    # The one-element explode keeps later filters on the answer from being
    # pushed below it, where the whole decision would be computed twice.
    return imports.withColumn("resolved_layer", F.explode(F.array(choice))).drop("_by_glob")


def _first(layers: tuple[Layer, ...], test) -> Column:
    return F.coalesce(*[F.when(test(layer), F.lit(layer.name)) for layer in layers])


def scan_layer(imports: DataFrame, layers: tuple[Layer, ...]) -> DataFrame:
    """L4 ``scan_layer``: light classification, prefix for files, contains for imports."""

    def heads(layer: Layer) -> list[str]:
        return [p.removesuffix("/**") for p in layer.paths]

    source = _first(
        layers,
        lambda ly: any_of(
            [F.col("file").startswith(h) | F.col("file").startswith(h.removeprefix("./")) for h in heads(ly)]
        ),
    )
    target = _first(layers, lambda ly: any_of([F.col("import_path").contains(h) for h in heads(ly)]))
    return imports.withColumns(
        {
            "source_layer": F.coalesce(source, F.lit("unknown")),
            "target_layer": F.coalesce(target, F.lit("external")),
        }
    )


def layer_files(edges: DataFrame) -> DataFrame:
    """L5 ``layer_files``: distinct source files per layer, one row per file."""
    return edges.where("source_layer is not null").select(
        "project_id", F.col("source_layer").alias("layer"), F.col("source_file").alias("file")
    ).distinct()


def layer_file_counts(edges: DataFrame) -> DataFrame:
    """L5 as counts."""
    return (
        edges.where("source_layer is not null")
        .groupBy("project_id", F.col("source_layer").alias("layer"))
        .agg(F.countDistinct("source_file").alias("n_files"))
    )


def infer_layers(files: DataFrame, conventions: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """L6 ``infer_layers``: suggested layers from conventional directories that exist.

    Each file contributes only the convention directories it lies under, so the
    shuffled set is at most projects x conventions.
    """
    conventions = conventions or CONVENTIONS
    known = [
        F.struct(
            F.lit(i).alias("ord"), F.lit(name).alias("name"), F.lit(j).alias("pos"), F.lit(folder).alias("folder")
        )
        for i, (name, folders) in enumerate(conventions.items(), 1)
        for j, folder in enumerate(folders)
    ]
    above = ancestors(F.col("path"))
    hits = F.filter(F.array(*known), lambda k: F.array_contains(above, k["folder"]))
    present = (
        files.select("project_id", F.explode(hits).alias("hit"))
        .groupBy("project_id", "hit.ord", "hit.name", "hit.pos", "hit.folder")
        .agg(F.count(F.lit(1)).alias("n_files"))
    )
    return present.groupBy("project_id", "ord", "name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "folder"))), lambda x: F.concat(x["folder"], F.lit("/**"))
        ).alias("paths")
    )


def infer_rules(layers: DataFrame, templates=DEFAULT_RULES) -> DataFrame:
    """L7 ``infer_rules``: default rules for the layer pairs a project has.

    ``layers`` has (project_id, ord, name); layer names fold to one array per
    project, and the templates are literal.
    """
    names = layers.groupBy("project_id").agg(
        F.transform(
            F.array_sort(F.collect_set(F.struct(F.col("ord"), F.col("name")))), lambda layer: layer["name"]
        ).alias("names")
    )

    def has(layer: str) -> Column:
        return F.array_contains("names", layer)

    def rule(ord_: int, id_: str, source: str, to: Column, type_: str, severity: str) -> Column:
        return F.struct(
            F.lit(ord_).alias("ord"),
            F.lit(id_).alias("id"),
            F.lit(source).alias("from_layer"),
            to.alias("to_layers"),
            F.lit(type_).alias("type"),
            F.lit(severity).alias("severity"),
        )

    options, ord_ = [], 0
    for id_, source, target, type_, severity in templates:
        if type_ == "Can" and not any(o is _CIRCULAR for o in options):
            options.append(_CIRCULAR)
        options.append((id_, source, target, type_, severity))
    columns = []
    for option in options:
        ord_ += 1
        if option is _CIRCULAR:
            others = F.filter("names", lambda n: n != "domain")
            columns.append(
                F.when(
                    F.size("names") >= 2, rule(ord_, "layer-circular", "domain", others, "MustNotCircular", "error")
                )
            )
        else:
            id_, source, target, type_, severity = option
            columns.append(
                F.when(has(source) & has(target), rule(ord_, id_, source, F.array(F.lit(target)), type_, severity))
            )
    return names.select("project_id", F.explode(F.array_compact(F.array(*columns))).alias("r")).select(
        "project_id", "r.*"
    )


_CIRCULAR = object()


def resolve_projects(projects: DataFrame, entries: list[str]) -> DataFrame:
    """L8 ``resolve_projects``: projects (distinct) selected by globs or explicit paths."""
    return projects.where(_selects(entries)).select("path").distinct()


def _selects(entries: list[str]) -> Column:
    return any_of([_entry_matches(e) for e in entries])


def _entry_matches(entry: str) -> Column:
    path = F.col("path")
    return glob_match(path, entry, "expect") if any(c in entry for c in "*?[") else path == entry


def unmatched_entries(projects: DataFrame, entries: list[str]) -> DataFrame:
    """Glob entries that select no project."""
    globs = [e for e in entries if any(c in e for c in "*?[")]
    seen = projects.agg(*[F.max(_entry_matches(e).cast("int")).alias(f"e{i}") for i, e in enumerate(globs)])
    misses = F.array(
        *[F.when(F.coalesce(F.col(f"e{i}"), F.lit(0)) == 0, F.lit(e)) for i, e in enumerate(globs)]
    )
    return seen.select(F.explode(F.array_compact(misses)).alias("entry"))


def merge_config(projects: DataFrame, shared: dict[str, Column], fields: list[str]) -> DataFrame:
    """L9 ``merge_config``: a non-empty override replaces the whole shared field."""
    return projects.withColumns(
        {f: F.when(F.size(F.coalesce(F.col(f), F.array())) > 0, F.col(f)).otherwise(shared[f]) for f in fields}
    )
