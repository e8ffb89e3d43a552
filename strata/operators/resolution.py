"""Import resolution (X13-X19) and the edge-building pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import languages as lg
from strata.functions.globs import any_of, glob_match, segment_regex
from strata.functions.paths import base_name, clean_path, dir_name, join_path
from strata.model import Layer
from strata.operators.extraction import file_stem, generated_header
from strata.operators.layers import assign_target_layer
from strata.session import materialise

REST = 1 << 20


def is_external(imports: DataFrame) -> DataFrame:
    """X13 ``is_external``: standard-library and vendor imports, by literal lists per language."""
    raw, lang = F.col("import_path"), F.col("language")
    tests = []
    for name, profile in lg.PROFILES.items():
        parts = []
        if profile.external_exact:
            parts.append(raw.isin(*profile.external_exact))
        parts += [raw.startswith(p) for p in profile.external_prefixes]
        if parts:
            tests.append(F.when(lang == name, any_of(parts)))
    ruby_known = any_of([(raw == p) | raw.startswith(p + "/") for p in lg.RUBY_EXTERNAL])
    ruby_own = any_of([raw.startswith(p) for p in lg.RUBY_INTERNAL])
    tests.append(F.when(lang == "ruby", ruby_known | ~ruby_own))
    php_known = raw.startswith("vendor/") | any_of(
        [(raw == p) | raw.startswith(p + "\\") for p in lg.PHP_EXTERNAL]
    )
    php_own = any_of([raw.startswith(p) for p in lg.PHP_INTERNAL])
    tests.append(F.when(lang == "php", ~php_own & php_known))
    return imports.withColumn("is_external", F.coalesce(*tests, F.lit(False)))


def build_metadata(files: DataFrame) -> DataFrame:
    """X14 ``build_metadata``: module prefix and sub-modules from build files at the project root.

    Returns (project_id, build_file, module_prefix, modules).
    """
    path, content = F.col("path"), F.col("content")
    known = files.where(path.isin("go.mod", "pom.xml", "build.gradle", "build.gradle.kts"))
    go = F.regexp_extract(content, r"(?m)^[ \t]*module[ \t]+(\S+)", 1)
    own = F.regexp_replace(
        content, r"(?s)<!--.*?-->|<(parent|dependencies|dependencyManagement|build|profiles)>.*?</\1>", ""
    )

    def tag(name: str) -> Column:
        return F.regexp_extract(own, rf"<{name}>\s*([^<\s]+)\s*</{name}>", 1)

    def setting(name: str) -> Column:
        return F.regexp_extract(content, rf"(?m)^\s*{name}\s*=\s*['\"]([^'\"]+)['\"]", 1)

    def dotted(a: Column, b: Column) -> Column:
        return F.when((a != "") & (b != ""), F.concat(a, F.lit("."), b)).otherwise("")

    name = F.coalesce(F.nullif(setting(r"rootProject\.name"), F.lit("")), setting(r"project\.name"))
    prefix = (
        F.when(path == "go.mod", go)
        .when(path == "pom.xml", dotted(tag("groupId"), tag("artifactId")))
        .otherwise(dotted(setting("group"), name))
    )
    modules = F.when(
        path == "pom.xml", F.regexp_extract_all(own, F.lit(r"<module>\s*([^<]+?)\s*</module>"), F.lit(1))
    ).otherwise(F.array().cast("array<string>"))
    return known.select("project_id", path.alias("build_file"), prefix.alias("module_prefix"), modules.alias("modules"))


def resolve_alias(imports: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """X15 ``resolve_alias``: TypeScript path aliases; exact first, then the longest prefix."""
    raw = F.col("import_path")
    clean = {a.removesuffix("/*"): t.removesuffix("/*") for a, t in aliases.items()}
    exact = [F.when(raw == a, F.lit(t)) for a, t in clean.items()]
    nested = [
        F.when(raw.startswith(a + "/"), clean_path(F.concat(F.lit(t + "/"), F.substring(raw, len(a) + 2, REST))))
        for a, t in sorted(clean.items(), key=lambda kv: -len(kv[0]))
    ]
    hit = F.when(F.col("language") == "typescript", F.coalesce(F.lit(None).cast("string"), *exact, *nested))
    return imports.withColumns({"aliased": hit.isNotNull(), "resolved_import": F.coalesce(hit, raw)})


def normalise_import(imports: DataFrame) -> DataFrame:
    """X16 ``normalise_import``: imports as project-relative paths in ``norm``.

    Reads ``module_prefix`` when present (Go) and ``resolved_import`` when
    present (TypeScript). Relative imports resolve against the importing file.
    """
    lang, raw = F.col("language"), F.col("import_path")
    folder = dir_name(F.col("source_file"))
    relative = clean_path(join_path(folder, raw))
    prefix = F.col("module_prefix") if "module_prefix" in imports.columns else F.lit("")
    prefix = F.coalesce(prefix, F.lit(""))
    inside = F.ltrim(F.substring(raw, F.length(prefix) + 1, F.lit(REST)), F.lit("/"))
    go = (
        F.when((prefix != "") & F.startswith(raw, prefix), inside)
        .when(raw.startswith("."), relative)
        .when(raw.startswith("internal/"), raw)
    )
    target = F.col("resolved_import") if "resolved_import" in imports.columns else raw
    ts = F.when(target.startswith("."), clean_path(join_path(folder, target))).otherwise(target)
    slashes = F.replace(raw, F.lit("."), F.lit("/"))
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    tail = F.replace(F.substring(raw, dots + 1, F.lit(REST)), F.lit("."), F.lit("/"))
    python = F.when(raw.startswith("."), clean_path(join_path(folder, F.concat(up, tail)))).otherwise(slashes)
    bare = F.regexp_replace(raw, r"^(?:crate::)?(?:self::)?(?:super::)*", "")
    rust = F.replace(bare, F.lit("::"), F.lit("/"))
    dotted_path = raw.startswith("./") | raw.startswith("../")
    php = F.when(dotted_path, relative).otherwise(F.replace(raw, F.lit("\\"), F.lit("/")))
    ruby = F.when(dotted_path, relative).otherwise(raw)
    norm = (
        F.when(lang == "go", go)
        .when(lang == "typescript", ts)
        .when(lang == "python", python)
        .when(lang.isin("java", "kotlin", "csharp"), slashes)
        .when(lang == "rust", rust)
        .when(lang == "php", php)
        .when(lang == "ruby", ruby)
        .otherwise(raw)
    )
    return imports.withColumn("norm", norm)


def candidate_paths(language: Column, norm: Column) -> Column:
    """Candidate files of a normalised import, in search order."""
    dotless = F.when(language == "ruby", F.replace(norm, F.lit("."), F.lit("/"))).otherwise(norm)
    base = base_name(dotless)

    def fill(template: str) -> Column:
        parts = []
        for i, piece in enumerate(template.replace("{b}", "{p}").split("{p}")):
            if i:
                parts.append(base if i == 2 else dotless)
            if piece:
                parts.append(F.lit(piece))
        return F.concat(*parts)

    options = [
        F.when(language == name, F.array(*[fill(t) for t in profile.candidates]))
        for name, profile in lg.PROFILES.items()
        if profile.candidates
    ]
    return F.coalesce(*options, F.array().cast("array<string>"))


def file_index(files: DataFrame) -> DataFrame:
    """Lookup keys of a corpus: every path, plus ``dir/*.ext`` for any file of a directory."""
    path = F.col("path")
    group = F.when(
        path.endswith(".java") | path.endswith(".kt"),
        F.concat(dir_name(path), F.lit("/*."), F.substring_index(path, ".", -1)),
    )
    keys = F.explode(F.array_compact(F.array(path, group)))
    return files.select("project_id", keys.alias("candidate"), path.alias("target_path")).groupBy(
        "project_id", "candidate"
    ).agg(F.min("target_path").alias("target_path"))


def resolve_candidates(imports: DataFrame, files: DataFrame) -> DataFrame:
    """X17 ``resolve_candidates``: first candidate file that exists, as ``target_path``.

    Popular imports collapse to one row per (project, language, import) before
    anything is shuffled by candidate; the answer joins back on that key. Imports that
    have no candidate (external ones have no normalised form) take no part in a shuffle, nor
    do files whose names end like no candidate.
    """
    key = ["project_id", "language", "norm"]
    searched = [name for name, profile in lg.PROFILES.items() if profile.candidates]
    asks = F.col("norm").isNotNull() & F.coalesce(F.col("language").isin(*searched), F.lit(False))
    distinct = imports.where(asks).select(*key).distinct()
    endings = sorted({"." + c.rpartition(".")[2] for name in searched for c in lg.PROFILES[name].candidates})
    files = files.where(any_of([F.col("path").endswith(e) for e in endings]))
    asked = distinct.select(*key, F.posexplode(candidate_paths(F.col("language"), F.col("norm"))).alias("pos", "candidate"))
    found = (
        asked.join(file_index(files), ["project_id", "candidate"])
        .groupBy(*key)
        .agg(F.min_by("target_path", "pos").alias("target_path"))
    )
    located = imports.where(asks).join(found, key, "left").select(*imports.columns, "target_path")
    return located.unionByName(imports.where(~asks).withColumn("target_path", F.lit(None).cast("string")))


@dataclass(frozen=True)
class Mapping:
    """Cross-language mapping from sources to generated files."""

    source_glob: str
    generated_glob: str
    language: str
    strategy: str = "stem"
    header_patterns: tuple[str, ...] = ()


def _picked(files: DataFrame, glob: str) -> DataFrame:
    rx = segment_regex(glob)
    return files.where(F.lit(False) if rx is None else F.col("path").rlike(rx))


def cross_lang_stem(files: DataFrame, mapping: Mapping) -> DataFrame:
    """X18 ``cross_lang_stem``: source file -> generated file of the same stem.

    The first generated file per stem wins and must carry a generated header;
    it is chosen by a map-side aggregate, so the join's right side is unique.
    """
    stem = file_stem(F.col("path"))
    headed = generated_header(files, mapping.header_patterns).select("project_id", "path")
    first = (
        _picked(files, mapping.generated_glob)
        .groupBy("project_id", stem.alias("stem"))
        .agg(F.min("path").alias("path"))
        .join(_picked(headed, mapping.generated_glob), ["project_id", "path"], "left_semi")
    )
    sources = _picked(files, mapping.source_glob).select("project_id", F.col("path").alias("source_file"), stem.alias("stem"))
    return sources.join(first, ["project_id", "stem"]).select(
        "project_id",
        "source_file",
        F.lit(1).alias("source_line"),
        F.col("path").alias("import_path"),
        F.lit(None).cast("string").alias("resolved_layer"),
        F.lit("cross").alias("language"),
    )


def cross_lang_glob(files: DataFrame, mapping: Mapping) -> DataFrame:
    """X19 ``cross_lang_glob``: every source to every generated file, in factored form.

    The pairs of a project are a full bipartite set. Writing them out squares a
    hot project, so each side is listed once: (project_id, side, path) plus the
    size of the other side; a path's degree is ``n_other`` and the pairs are
    exactly the product of the two sides.
    """
    sources = _picked(files, mapping.source_glob).select("project_id", F.lit("source").alias("side"), "path")
    generated = _picked(generated_header(files, mapping.header_patterns), mapping.generated_glob).select(
        "project_id", F.lit("generated").alias("side"), "path"
    )
    members = sources.unionByName(generated)
    sizes = members.groupBy("project_id").agg(
        F.count(F.when(F.col("side") == "source", 1)).alias("n_source"),
        F.count(F.when(F.col("side") == "generated", 1)).alias("n_generated"),
    )
    return (
        members.join(sizes, "project_id")
        .withColumn("n_other", F.when(F.col("side") == "source", F.col("n_generated")).otherwise(F.col("n_source")))
        .where("n_other > 0")
        .select("project_id", "side", "path", "n_other")
    )


def cross_lang_glob_coupling(files: DataFrame, mapping: Mapping, layer: Column) -> DataFrame:
    """X19 rolled up to layers: edge counts per layer pair, as products of side counts."""
    sides = cross_lang_glob(files, mapping).withColumn("layer", layer).groupBy("project_id", "side", "layer").agg(
        F.count(F.lit(1)).alias("n")
    )
    a = sides.where("side = 'source'").select("project_id", F.col("layer").alias("source_layer"), F.col("n").alias("a"))
    b = sides.where("side = 'generated'").select(
        "project_id", F.col("layer").alias("target_layer"), F.col("n").alias("b")
    )
    return a.join(b, "project_id").select(
        "project_id", "source_layer", "target_layer", (F.col("a") * F.col("b")).alias("cnt")
    )


def resolve_imports(
    imports: DataFrame,
    files: DataFrame,
    layers: tuple[Layer, ...],
    aliases: dict[str, str] | None = None,
) -> DataFrame:
    """X13-X17 then L3: raw imports to edges with ``resolved_layer``.

    Languages other than Go and TypeScript keep only resolved edges. The imports are
    written once, normalised, since resolution reads them several times and they are far
    smaller than the corpus they were extracted from. So are the module prefixes, a row a
    project: planned on their size, the join need not gather a project's imports in one task.
    """
    modules = materialise(
        build_metadata(files)
        .where("build_file = 'go.mod'")
        .groupBy("project_id")
        .agg(F.min("module_prefix").alias("module_prefix"))
    )
    staged = resolve_alias(is_external(imports).join(modules, "project_id", "left"), aliases or {})
    located = resolve_candidates(materialise(normalise_import(staged)), files)
    edges = assign_target_layer(located, layers)
    return edges.where(F.col("language").isin("go", "typescript") | F.col("resolved_layer").isNotNull())
