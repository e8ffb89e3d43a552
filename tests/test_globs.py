"""Globs in every dialect against brute-force models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strata.functions.globs import glob_match, glob_regex, segment_regex
from strata.functions.paths import ancestors, clean_path, extension, stem
from strata.operators.layers import assign_source_layer, assign_source_layer_by_table
from strata.model import Layer, layers_table

PATHS = [
    "internal/domain/order.go",
    "internal/domain",
    "internal/domains/x.go",
    "src/app/main.ts",
    "a/b/c.go",
    "a.b/c",
    "vendor/x/y.go",
    "x/vendor/y.go",
    "build",
    "lib/a_spec.rb",
    "logs/2024/app.log",
]


def hits(spark, glob, dialect):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    return {r.path for r in df.where(glob_match(F.col("path"), glob, dialect)).collect()}


@pytest.mark.parametrize(
    ("glob", "dialect", "want"),
    [
        ("internal/domain/**", "layer", {"internal/domain/order.go", "internal/domain"}),
        ("**/domain/**", "layer", {"internal/domain/order.go", "internal/domain"}),
        ("internal/*/order.go", "layer", {"internal/domain/order.go"}),
        ("internal/domain", "layer", {"internal/domain/order.go", "internal/domain", "internal/domains/x.go"}),
        ("internal/domain/", "layer", {"internal/domain/order.go"}),
        ("vendor/", "exclude", {"vendor/x/y.go"}),
        ("internal/domain", "exclude", {"internal/domain"}),
        ("vendor/**", "suffix", {"vendor/x/y.go", "x/vendor/y.go"}),
        ("vendor/", "ignore", {"vendor/x/y.go"}),
        ("*.go", "ignore", {p for p in PATHS if p.endswith(".go")}),
        ("**/*_spec.rb", "ignore", {"lib/a_spec.rb"}),
        ("logs/**/*.log", "ignore", {"logs/2024/app.log"}),
        ("src/**", "ignore", {"src/app/main.ts"}),
        ("**", "ignore", set(PATHS)),
        ("src/app/**", "diagram", {"src/app/main.ts"}),
        ("src/**.ts", "expect", {"src/app/main.ts"}),
        ("*.go", "watch", {p for p in PATHS if p.endswith(".go")}),
        ("vendor/", "watch", {"vendor/x/y.go", "x/vendor/y.go"}),
        ("logs/*", "watch", {"logs/2024/app.log"}),
        ("build", "watch", {"build"}),
        ("a/**", "walk_include", {"a/b/c.go"}),
        ("**/vendor", "walk_exclude", {"x/vendor/y.go"}),
        ("a.b/c", "layer", {"a.b/c"}),
    ],
)
def test_dialects(spark, glob, dialect, want):
    assert hits(spark, glob, dialect) == want


def test_column_and_regex_agree_on_random_globs(spark):
    rng = random.Random(7)
    pieces = ["a", "b", "*", "**", "c.d"]
    globs = {"/".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(40)}
    paths = {"/".join(rng.choice(["a", "b", "c.d", "cxd", "ab"]) for _ in range(rng.randint(1, 5))) for _ in range(60)}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for glob in sorted(globs):
        for dialect in ("layer", "exclude"):
            rx = re.compile(glob_regex(glob, dialect))
            got = {r.path for r in df.where(glob_match(F.col("path"), glob, dialect)).collect()}
            assert got == {p for p in paths if rx.search(p)}, (glob, dialect)


def test_malformed_segment_glob_matches_nothing():
    assert segment_regex("a[") is None
    assert segment_regex("a\\") is None


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../c//d.tar.GZ",)], "p string")
    row = df.select(
        clean_path(F.col("p")).alias("c"), extension(F.col("p")).alias("e"), stem(F.col("p")).alias("s"),
        ancestors(F.lit("x/y/z")).alias("a"),
    ).first()
    assert (row.c, row.e, row.s, row.a) == ("a/c/d.tar.GZ", ".gz", "d", ["x", "x/y"])
    up = spark.range(1).select(clean_path(F.lit("../../a")).alias("c")).first()
    assert up.c == "../../a"


def test_first_layer_wins_and_table_form_agrees(spark, rows):
    layers = (Layer("a", ("src/**",)), Layer("b", ("src/app/**", "lib/*.rb")), Layer("c", ("vendor/",)))
    deps = spark.createDataFrame([("p", p) for p in PATHS], "project_id string, source_file string")
    literal = rows(assign_source_layer(deps, layers), "source_file", F.coalesce("source_layer", F.lit("")))
    table = layers_table(spark, layers, "p")
    by_table = rows(
        assign_source_layer_by_table(deps, table), "source_file", F.coalesce("source_layer", F.lit(""))
    )
    assert literal == by_table
    assert ("src/app/main.ts", "a") in literal
