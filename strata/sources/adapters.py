"""Adapters from general tables to edges, files, diffs and violations.

They only select, join on keys and build strings; no row is dropped or sampled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.globs import first_match
from strata.functions.languages import LANGUAGES
from strata.model import Config, Layer, Override, Rule

# --- fixed values: the trade config -------------------------------------------
TRADE = Config(
    layers=(
        Layer("domain", ("africa/**",)),
        Layer("application", ("america/**",)),
        Layer("infrastructure", ("asia/**", "europe/nation_1*/**")),
        Layer("presentation", ("europe/**",)),
    ),
    rules=(
        Rule(
            "domain-imports-infrastructure",
            "domain",
            ("infrastructure",),
            overrides=(
                Override("africa/", "warning"),
                Override("africa/nation_0/", "info"),
                Override("africa/nation_10", enabled=False),
            ),
        ),
        Rule(
            "application-hides-views",
            "application",
            ("presentation", "infrastructure"),
            severity="warning",
            explanation="Keep views out",
            exclude=("america/nation_1/**", "america/nation_6/s*1"),
        ),
        Rule("no-hot-customers", pattern="/c[0-9]*7$", severity="info", overrides=(Override("europe/", "warning"),)),
        Rule("presentation-legacy", "presentation", ("domain",), "MustNotCircular", pattern="nation_(0|5)/"),
        Rule("infrastructure-imports-domain", "infrastructure", ("domain",), "Can", "info"),
        Rule("domain-needs-account", "domain", ("application",), "Must", pattern="/c1[0-9]1$"),
        Rule("presentation-needs-adapters", "presentation", ("infrastructure",), "Must"),
        Rule("layer-circular", "domain", ("application",), "MustNotCircular"),
    ),
)

# --- fixed values: the source-corpus config --------------------------------------
CORPUS_LAYERS = tuple(
    Layer(name, (*own, f"src/{name}/**", f"src/main/*/{name}/**", f"lib/{name}/**", f"Sources/{name}/**", f"src/{cap}/**"))
    for name, cap, own in (
        ("domain", "Domain", ("domain/**",)),
        ("application", "Application", ("application/**",)),
        ("infrastructure", "Infrastructure", ()),
        ("presentation", "Presentation", ("presentation/**",)),
    )
)
CORPUS = Config(
    layers=CORPUS_LAYERS,
    rules=(
        Rule("domain-imports-infrastructure", "domain", ("infrastructure",)),
        Rule("domain-imports-presentation", "domain", ("presentation",), severity="warning"),
        Rule("application-imports-presentation", "application", ("presentation",), explanation="Views stay outside"),
        Rule("no-wildcards", pattern="^[a-z]+$", severity="info"),
    ),
)
ALIASES = {"@domain/*": "src/domain/*", "@app": "src/application", "@app/views": "src/presentation"}
LAYER_NAMES = ("domain", "application", "infrastructure", "presentation")

# One source line per text line, by language. {l}/{c}: layer of the imported
# file (lower, capitalised), {m}: own layer, {T}: imported id, {w}: a word of the text.
LINES = {
    "go": (
        'import "example.com/fleet/{l}/d{T}"',
        "import (",
        '\t"example.com/fleet/{l}/d{T}"',
        '\talias "example.com/fleet/{l}/{w}"',
        ")",
        "func {w}() {}",
        'import "fmt"',
    ),
    "typescript": (
        "import { {w} } from '@domain/d{T}'",
        'import type { {w} } from "./d{T}"',
        "const {w} = require('../{l}/d{T}')",
        'export * from "../{l}/d{T}"',
        'const x = await import("@scope/{l}/d{T}")',
        "// import x from 'skip'",
        'import React from "react"',
        'import {w} from "@app/views/{w}"',
    ),
    "python": (
        "import {l}.d{T}",
        "from {l}.d{T} import {w}",
        "from .d{T} import {w}",
        "from ..{l} import {w}",
        "# import os",
        "import os, {w}",
    ),
    "java": (
        "import {l}.D{T};",
        "import static {l}.D{T}.run;",
        "import {l}.*;",
        "import java.util.List;",
        "package {m};",
        "class {w} {}",
    ),
    "kotlin": (
        "import {l}.D{T} as X",
        "import {l}.*",
        "import {l}.D{T}",
        "import kotlin.math.abs",
        "package {m}",
        "fun {w}() {}",
    ),
    "rust": (
        "use crate::{l}::d{T};",
        "pub use self::{l}::d{T};",
        "use super::{l}::{w}; // note",
        "use {l}::d{T};",
        "use std::fmt;",
        "pub mod {w}x;",
    ),
    "csharp": (
        "using X = {l}.D{T};",
        "using static {l}.D{T};",
        "using Company.{l}.D{T}; // note",
        "using System.Text;",
        "namespace {m}.{w}",
        "// using nothing;",
    ),
    "ruby": (
        "require_relative '../{l}/d{T}'",
        "require 'lib/{l}/d{T}'",
        "require_all 'app/{l}'",
        "require File.expand_path('../{l}/d{T}', __FILE__)",
        "require 'json'",
        "# require 'x'",
        "require '{l}/d{T}' # note",
    ),
    "php": (
        "use {c}\\D{T};",
        "use {c}\\D{T} as X;",
        "use function {c}\\f{T};",
        "use const {c}\\C{T};",
        "require_once __DIR__ . '/../{c}/D{T}.php';",
        "use Symfony\\Component\\Http;",
        "// use {w};",
    ),
    "swift": (
        "import {c}",
        "@_exported import {c}",
        "import struct {c}.D{T}",
        "import Foundation",
        "import D{T} // note",
        "// import {w}",
    ),
}
# Path of a file by language: (folder, file name, test suffix); {m}/{k}: layer (lower, capitalised).
PATHS = {
    "go": ("{m}", "d", ".go", "_test.go"),
    "typescript": ("src/{m}", "d", ".ts", ".spec.ts"),
    "python": ("src/{m}", "d", ".py", ".py"),
    "java": ("src/main/java/{m}", "D", ".java", "Test.java"),
    "kotlin": ("src/main/kotlin/{m}", "D", ".kt", "Tests.kt"),
    "rust": ("src/{m}", "d", ".rs", "_test.rs"),
    "csharp": ("src/{m}", "D", ".cs", "Tests.cs"),
    "ruby": ("lib/{m}", "d", ".rb", "_spec.rb"),
    "php": ("src/{k}", "D", ".php", "Test.php"),
    "swift": ("Sources/{m}", "D", ".swift", "Tests.swift"),
}
# Build files by document language (the project): file -> content.
BUILD_FILES = {
    "en": (
        ("go.mod", "module example.com/fleet\n\ngo 1.22\n"),
        ("tsconfig.json", "{}"),
        ("pyproject.toml", "[project]"),
        (
            "pom.xml",
            "<project><parent><groupId>org.base</groupId></parent><groupId>com.fleet</groupId>"
            "<artifactId>core</artifactId><modules><module>api</module><module>db</module></modules></project>",
        ),
        ("Cargo.toml", "[package]"),
        ("fleet.csproj", "<Project/>"),
        ("Gemfile", "source"),
        ("composer.json", "{}"),
        ("Package.swift", "// swift"),
    ),
    "de": (
        ("package.json", "{}"),
        ("build.gradle.kts", "group = \"de.fleet\"\nrootProject.name = \"kern\"\n"),
        ("Cargo.toml", "[package]"),
    ),
    "fr": (
        ("go.mod", "// head\nmodule example.com/fleet\n"),
        ("build.gradle", "group = 'fr.fleet'\nproject.name = 'coeur'\n"),
        ("fleet.sln", "sln"),
    ),
    "es": (("setup.py", "setup()"), ("Gemfile", "source"), ("settings.gradle.kts", "x")),
}
# ----------------------------------------------------------------------------------

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def places(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    head = F.lower(F.replace("r_name", F.lit(" "), F.lit("_")))
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.concat(head, F.lit("/"), F.lower("n_name")).alias("place")
    )


def deps_from_trade(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from order lines: supplier "imports" customer, project is the order priority.

    Suppliers join first, while the line table is narrow, as two numbers (a small
    supplier side is broadcast on its file's size); their paths are put together
    behind the last join. Customers join the orders on their own, and their layer is
    found per customer, not per line.
    """
    located = places(spark, folder)
    suppliers = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("_nation"))
    sources = located.select(F.col("n_nationkey").alias("_nation"), F.col("place").alias("_place"))
    customers = (
        table(spark, folder, "customer")
        .join(located, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.concat("place", F.lit("/c"), F.col("c_custkey").cast("string")).alias("import_path"))
        .withColumn("resolved_layer", first_match(F.col("import_path"), TRADE.layers))
    )
    orders = (
        table(spark, folder, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", F.col("o_orderpriority").alias("project_id"), "import_path", "resolved_layer")
    )
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag")
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(sources, "_nation")
        .select(
            "project_id",
            F.concat("_place", F.lit("/s"), F.col("s_suppkey").cast("string")).alias("source_file"),
            F.col("l_linenumber").alias("source_line"),
            "import_path",
            "resolved_layer",
            F.col("l_returnflag").alias("language"),
        )
    )


def _literal(text: str) -> str:
    """A SQL string literal."""
    for raw, safe in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\t", "\\t")):
        text = text.replace(raw, safe)
    return f"'{text}'"


def _filled(template: str, values: dict[str, str]) -> str:
    """SQL for a literal template with {x} placeholders."""
    pieces = re.split("(" + "|".join(r"\{" + k + r"\}" for k in values) + ")", template)
    return "concat(" + ", ".join(values[p[1:-1]] if p[1:-1] in values and p[0] == "{" else _literal(p) for p in pieces if p) + ")"


def _layer_sql(number: str) -> str:
    names = ", ".join(_literal(n) for n in LAYER_NAMES)
    return f"element_at(array({names}), cast(floor({number} / 10) % 4 + 1 as int))"


def _source_sql() -> str:
    """Source text of a document: one SQL lambda over its lines, by file language."""
    values = {"w": "s.w", "T": "cast(s.target as string)", "l": "s.l", "c": "initcap(s.l)", "m": "own"}
    arms = []
    for n, language in enumerate(LANGUAGES):
        options = LINES[language]
        inner = " ".join(f"WHEN {i} THEN {_filled(t, values)}" for i, t in enumerate(options))
        arms.append(f"WHEN {n} THEN CASE s.i % {len(options)} {inner} END")
    words = (
        "transform(split(text, '\\n'), (t, i) -> named_struct('i', i, "
        "'w', coalesce(nullif(lower(regexp_extract(t, '[A-Za-z]+', 0)), ''), 'w'), "
        "'target', greatest(doc_id + 10 * (i % 3 - 1), kind)))"
    )
    layered = f"transform({words}, x -> named_struct('i', x.i, 'w', x.w, 'target', x.target, 'l', {_layer_sql('x.target')}))"
    return f"array_join(transform({layered}, s -> CASE kind {' '.join(arms)} END), '\\n')"


def _path_sql() -> str:
    arms = []
    for n, language in enumerate(LANGUAGES):
        where, name, ext, test = PATHS[language]
        head = _filled(where + "/" + name, {"m": "own", "k": "initcap(own)"})
        arms.append(f"WHEN {n} THEN concat({head}, doc_id, if(doc_id % 53 = 5, '{test}', '{ext}'))")
    return f"concat(if(doc_id % 97 = 3, 'vendor/', ''), CASE kind {' '.join(arms)} END)"


def files_from_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A source corpus from documents: each text becomes one file, each text line one source line.

    Project is the document language, file language the id modulo ten; imported
    ids are the neighbours of the same file language. Row-local, so no shuffle.
    Every document also has a generated companion, and every project its build
    files.
    """
    docs = table(spark, folder, "documents")
    builds = " ".join(
        f"WHEN {_literal(k)} THEN array("
        + ", ".join(f"named_struct('path', {_literal(p)}, 'content', {_literal(c)})" for p, c in v)
        + ")"
        for k, v in BUILD_FILES.items()
    )
    markers = (
        docs.select("lang")
        .distinct()
        .select(F.col("lang").alias("project_id"), F.expr(f"explode(CASE lang {builds} END)").alias("b"))
        .select("project_id", "b.path", "b.content")
    )
    return file_columns(docs).unionByName(markers)


def file_columns(documents: DataFrame) -> DataFrame:
    """Shape document rows (batch or stream) as source files and their companions."""
    docs = documents.selectExpr(
        "doc_id", "text", "lang", "n_chars", "doc_id % 10 AS kind", f"{_layer_sql('doc_id')} AS own"
    )
    # both paths come from one scan; content stays a lazy column of the row
    rows = docs.withColumn(
        "f",
        F.expr(
            f"explode(array(named_struct('path', {_path_sql()}, 'made', false), "
            "named_struct('path', concat('gen/d', doc_id, '.pb.go'), 'made', true)))"
        ),
    )
    header = "if(n_chars % 2 = 0, '// Code generated by protoc-gen-go. DO NOT EDIT.\\n', '// by hand\\n')"
    return rows.selectExpr(
        "lang AS project_id", "f.path AS path", f"if(f.made, concat({header}, text), {_source_sql()}) AS content"
    )


def diffs_from_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One change per source file of the corpus: (project_id, pr, text) as a unified diff.

    Every text line becomes a diff line (added, removed or kept by position)
    and every twentieth line opens a new hunk.
    """
    docs = table(spark, folder, "documents").selectExpr(
        "doc_id", "text", "lang", f"concat('src/', {_layer_sql('doc_id')}, '/d', doc_id, '.py') AS path"
    )
    lines = (
        "transform(split(text, '\\n'), (t, i) -> concat("
        "if(i % 20 = 0, concat('@@ -', i + 1, ',5 +', i + 1, ',6 @@ part\\n'), ''), "
        "CASE i % 4 WHEN 3 THEN '-' WHEN 1 THEN ' ' ELSE '+' END, t))"
    )
    head = "'diff --git a/', path, ' b/', path, '\\nindex 1..2 100644\\n--- a/', path, '\\n+++ b/', path, '\\n'"
    return docs.selectExpr(
        "lang AS project_id", "doc_id AS pr", f"concat({head}, array_join({lines}, '\\n')) AS text"
    )


def deps_from_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Link edges from web pages: page path -> href, project is the host."""
    page = table(spark, folder, "pages").select("page_id", "url", "html")
    return page.select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("project_id"),
        F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("source_file"),
        F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "import_path"),
    ).select("project_id", "source_file", (F.col("pos") + 1).alias("source_line"), "import_path")


def violations_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """A violation log from events: one row per event, its day is the run."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return violation_columns(events)


def violation_columns(events: DataFrame) -> DataFrame:
    """Shape raw event rows (batch or stream) as violations."""
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.array(*[F.lit(n) for n in LAYER_NAMES])
    ts = F.col("ts").cast("timestamp")
    day = F.to_date(ts)
    return events.select(
        F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project_id"),
        ts.alias("ts"),
        day.alias("run_date"),
        F.concat(F.lit("E-"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("rule-"), "event_type").alias("rule_id"),
        F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("file"),
        k.alias("line"),
        F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")).alias("source_layer"),
        F.element_at(names, (k % 4 + 1).cast("int")).alias("target_layer"),
        F.concat(F.lit("mod/m"), (k % 20).cast("string")).alias("import_path"),
        F.concat("event_type", F.lit(" at "), k.cast("string")).alias("message"),
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "purchase", "warning")
        .otherwise("info")
        .alias("severity"),
        (F.col("value") > 400).alias("overridden"),
        F.sha2(F.concat(F.lit("cfg"), F.floor(F.dayofmonth(day) / 10).cast("string")), 256).alias("config_hash"),
    )


def changes_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """File-change events from events: (project_id, path, op, ts)."""
    events = table(spark, folder, "events").select("ts", "user_id", "event_type", "props")
    return change_columns(events)


def change_columns(events: DataFrame) -> DataFrame:
    """Shape raw event rows (batch or stream) as file changes."""
    op = (
        F.when(F.col("event_type") == "signup", "create")
        .when(F.col("event_type") == "error", "remove")
        .when(F.col("event_type") == "purchase", "rename")
        .otherwise("write")
    )
    return events.select(
        F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project_id"),
        F.concat(
            F.lit("src/u"), F.col("user_id").cast("string"), F.lit("/k"), F.get_json_object("props", "$.k"), F.lit(".py")
        ).alias("path"),
        op.alias("op"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
