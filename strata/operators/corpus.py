"""Corpus filters and change detection.

``files`` is (project_id, path, content); every filter here is a narrow
predicate on ``path``, so it prunes rows before ``content`` is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.globs import any_of, glob_match, matches_any
from strata.functions.languages import (
    DIGEST_BINARIES,
    DIGEST_EXTENSIONS,
    DIGEST_SKIP,
    PROFILES,
    WALK_SKIP,
)
from strata.functions.paths import ancestors, base_name, dir_name, extension
from strata.operators.ordered import set_digest
from strata.session import materialise


def folders(path: Column) -> Column:
    """Directory components of a path."""
    return F.split(dir_name(path), "/")


def _text_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def walk_layers(files: DataFrame, patterns: list[str], exclude: list[str] = ()) -> DataFrame:
    """S2 ``walk_layers``: files under any layer pattern, outside common and excluded directories."""
    path = F.col("path")
    parts = folders(path)
    blocked = F.arrays_overlap(parts, _text_array(WALK_SKIP)) | F.exists(parts, lambda d: d.startswith("."))
    if exclude:
        above = F.exists(ancestors(path), lambda d: matches_any(d, exclude, "walk_exclude"))
        blocked = blocked | matches_any(path, exclude, "walk_exclude") | above
    return files.where(~blocked & matches_any(path, patterns, "walk_include"))


def _marker_hit(path: Column, marker: str) -> Column:
    return glob_match(path, marker, "expect") if "*" in marker else path == marker


def detect_languages(files: DataFrame) -> DataFrame:
    """S3 ``detect_languages``: languages of a project by marker files at its root.

    Kotlin also counts when a Maven project holds Kotlin sources, Python when a
    top-level folder holds a module. One grouped pass over paths; content is
    never read.
    """
    path = F.col("path")
    tests = {
        lang: any_of([_marker_hit(path, m) for m in profile.markers]) for lang, profile in PROFILES.items()
    }
    tests["python"] = tests["python"] | path.rlike(r"^[^/]+/[^/]*\.py$")
    maven, kotlin = path == "pom.xml", source_filter(path, "kotlin")
    flags = [F.max(test.cast("int")).alias(lang) for lang, test in tests.items()]
    seen = files.groupBy("project_id").agg(
        *flags, F.max(maven.cast("int")).alias("_maven"), F.max(kotlin.cast("int")).alias("_kt")
    )
    both = (F.col("_maven") == 1) & (F.col("_kt") == 1)
    found = F.array_compact(
        F.array(
            *[
                F.when((F.col(lang) == 1) | (both if lang == "kotlin" else F.lit(False)), F.lit(lang))
                for lang in PROFILES
            ]
        )
    )
    return seen.select("project_id", F.explode(found).alias("language"))


def source_filter(path: Column, language: str, extensions: tuple[str, ...] = ()) -> Column:
    """S4 as a predicate; ``extensions`` overrides the language's own list."""
    profile = PROFILES[language]
    parts = folders(path)
    keep = any_of([path.endswith(e) for e in (extensions or profile.extensions)])
    test = any_of([path.endswith(s) for s in profile.test_suffixes])
    skip = F.arrays_overlap(parts, _text_array(profile.skip_dirs)) if profile.skip_dirs else F.lit(False)
    if profile.hidden_dirs:
        skip = skip | F.exists(parts, lambda d: d.startswith("."))
    if language == "go":
        skip = skip | path.contains("vendor/") | base_name(path).startswith(".")
    return keep & ~test & ~skip


def filter_source_files(files: DataFrame, overrides: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """S4 ``filter_source_files``: source files with their language, tests and build output dropped."""
    overrides = overrides or {}
    path = F.col("path")
    language = F.coalesce(
        *[F.when(source_filter(path, lang, overrides.get(lang, ())), F.lit(lang)) for lang in PROFILES]
    )
    return files.withColumn("language", language).where("language is not null")


def parse_ignore(text: str) -> list[str]:
    """Patterns of an ignore file: blank lines and comments dropped."""
    lines = [line.strip() for line in text.split("\n")]
    return [line for line in lines if line and not line.startswith("#")]


def ignore_filter(files: DataFrame, patterns: list[str]) -> DataFrame:
    """S5 ``ignore_filter``: drop files matched by an ignore pattern, or below a matched directory."""
    return files.where(~ignored(F.col("path"), patterns)) if patterns else files


def ignored(path: Column, patterns: list[str]) -> Column:
    """Does an ignore pattern match a path, or a directory above it?"""
    above = F.exists(ancestors(path), lambda d: matches_any(d, patterns, "ignore"))
    return matches_any(path, patterns, "ignore") | above


def manifest(files: DataFrame, config_hash: Column) -> DataFrame:
    """What a finished run remembers about its files."""
    return files.select(
        "project_id", "language", "path", F.sha2("content", 256).alias("content_hash"), config_hash.alias("config_hash")
    )


def dirty_files(files: DataFrame, known: DataFrame, config_hash: Column) -> DataFrame:
    """S6 ``dirty_files``: files whose content or config changed since ``known``.

    The anti join moves hashes only. Its answer, usually a few paths, is
    written, so the second read of the corpus picks those files by a join whose
    right side has a known size: small means broadcast, and content stays put.
    """
    keys = ["project_id", "language", "path", "content_hash", "config_hash"]
    changed = manifest(files, config_hash).join(known.select(*keys).distinct(), keys, "left_anti")
    paths = materialise(changed.select("project_id", "language", "path"))
    return files.join(paths, ["project_id", "language", "path"], "left_semi")


def retained_rows(deps: DataFrame, dirty: DataFrame, files: DataFrame) -> DataFrame:
    """Stored edges that stay valid, for union with the re-extracted ones.

    Edges of changed files and of files that no longer exist are dropped.
    """
    key = ["project_id", "source_file"]
    alive = files.select("project_id", F.col("path").alias("source_file")).distinct()
    changed = dirty.select("project_id", F.col("path").alias("source_file")).distinct()
    return deps.join(alive, key, "left_semi").join(changed, key, "left_anti")


def digest_filter(path: Column, language: str) -> Column:
    """Files that enter a project digest."""
    ext = extension(path)
    keep = ext.isin(*DIGEST_EXTENSIONS[language]) if language in DIGEST_EXTENSIONS else ~ext.isin(*DIGEST_BINARIES)
    return keep & ~F.arrays_overlap(folders(path), _text_array(DIGEST_SKIP))


def project_fingerprint(files: DataFrame, language: str) -> DataFrame:
    """S7 ``project_fingerprint``: order-independent digest of a project's file hashes."""
    hashes = files.where(digest_filter(F.col("path"), language)).select(
        "project_id", F.sha2("content", 256).alias("file_hash")
    )
    return set_digest(hashes, ["project_id"], "file_hash", name="fingerprint")
