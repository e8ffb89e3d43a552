"""Findings over whole configurations."""

import pytest
from pyspark.sql import functions as F

from strata.model import Layer, Rule, layers_table, rules_table
from strata.operators import linting

LAYERS = (Layer("a", ("a/**",)), Layer("b", ("b/**",)))


def lint(spark, rules=(), layers=LAYERS, checks=None, **tables):
    given = rules_table(spark, tuple(rules), "p")
    if checks:
        given = given.withColumn("check", F.coalesce(*[F.when(F.col("id") == k, F.lit(v)) for k, v in checks.items()], F.lit("")))
    return sorted((r.subject, r.finding) for r in linting.lint_config(given, layers_table(spark, layers, "p"), **tables).collect())


def test_a_sound_configuration_has_no_findings(spark):
    rules = [
        Rule("one", "a", ("b",)), Rule("two", pattern="^x(y|z)$"),
        Rule("three", template="max-deps", params={"from": "a", "to": ["b", "a"], "max": 3}),
        Rule("four", template="no-leak", params={"layer": "a", "forbidden": []}), Rule("five", template="layer-balance", params={"min": 1, "max": 2.0}), Rule("six"),
    ]
    functions = spark.createDataFrame([("p", "f", ["g", "count"]), ("p", "g", ["unknown"]), ("q", "g", ["f"])], "project_id string, name string, calls array<string>")
    plugins = spark.createDataFrame([("p", "own-1", "run", ["x"], "1m30s")], "project_id string, name string, command string, languages array<string>, timeout string")
    assert lint(spark, rules, checks={"six": "count() > 1"}, functions=functions, plugins=plugins) == []


@pytest.mark.parametrize(
    ("rule", "finding"),
    [
        (Rule("x", pattern="a("), "invalid pattern 'a('"),
        (Rule("x", pattern="(?<n>a)(?<n>b)"), "invalid pattern '(?<n>a)(?<n>b)'"),
        (Rule("x", template="none"), "unknown template 'none'"),
        (Rule("x", template="max-deps", params={"from": "a", "to": ["b"]}), "missing required param 'max' for template 'max-deps'"),
        (Rule("x", template="max-deps", params={"from": "a", "to": ["b"], "max": "many"}), "param 'max' for template 'max-deps': expected int"),
        (Rule("x", template="max-deps", params={"from": "a", "to": ["b"], "max": 1.5}), "param 'max' for template 'max-deps': expected int"),
        (Rule("x", template="no-leak", params={"layer": "c", "forbidden": ["b"]}), "template param 'layer' references unknown layer c"),
        (Rule("x", template="no-leak", params={"layer": "a", "forbidden": ["b", "d"]}), "template param 'forbidden' references unknown layer d"),
        (Rule("x", template="no-leak", params={"layer": "a", "forbidden": [1]}), "param 'forbidden' for template 'no-leak': expected []string"),
    ],
)
def test_rules(spark, rule, finding):
    assert ("x", finding) in lint(spark, [rule])


def test_checks_stand_alone(spark):
    got = lint(spark, [Rule("x", "a", ("b",), pattern="p", template="layer-balance", params={"min": 1, "max": 2})], checks={"x": "count() > 1"})
    assert got == [("x", f"'check' expression rules cannot have '{f}' field") for f in ("from", "pattern", "template", "to")]
    assert lint(spark, [Rule("x", severity="loud")], checks={"x": "1 > 2"}) == [("x", "invalid severity")]


def test_functions_plugins_mappings_and_settings(spark):
    functions = spark.createDataFrame(
        [("p", "f", ["g"]), ("p", "g", ["h"]), ("p", "h", ["f"]), ("p", "me", ["me"]), ("p", "count", []), ("p", "1x", None)], "project_id string, name string, calls array<string>"
    )
    assert lint(spark, functions=functions) == [
        ("1x", "invalid identifier"), ("count", "cannot shadow builtin 'count'"),
        ("f", "circular reference: f -> g -> h -> f"), ("me", "circular reference: me -> me"),
    ]
    plugins = spark.createDataFrame(
        [("p", "go", "run", ["x"], ""), ("p", "-x", "", [], "5 s"), ("p", "", "run", None, "3s"), ("p", "twice", "run", ["x"], None), ("p", "twice", "run", ["x"], None)],
        "project_id string, name string, command string, languages array<string>, timeout string",
    )
    assert lint(spark, plugins=plugins) == [
        ("", "at least one language must be specified"), ("", "plugin name is required"), ("-x", "at least one language must be specified"),
        ("-x", "command is required"), ("-x", "invalid timeout '5 s'"), ("-x", f"plugin name must match {linting.PLUGIN_NAME}"),
        ("go", "plugin name conflicts with a built-in detector"), ("twice", "duplicate plugin name"),
    ]
    mappings = spark.createDataFrame([("p", 1, "", "g", "", "regex"), ("p", 2, "s", "", "go", "")], "project_id string, ord int, source_glob string, generated_glob string, language string, strategy string")
    assert lint(spark, mappings=mappings) == [
        ("mapping 1", "language is required"), ("mapping 1", "match strategy must be 'stem' or 'glob'"), ("mapping 1", "source pattern is required"), ("mapping 2", "generated pattern is required"),
    ]
    settings = spark.createDataFrame([("p", -1, {"error": "fatal", "warning": "info"}), ("p", 0, None)], "project_id string, max_violations int, severity_map map<string,string>")
    assert lint(spark, settings=settings) == [("error", "severity map target 'fatal' is invalid"), ("max_violations", "max_violations cannot be negative (got -1)")]


def test_layers(spark):
    layers = (Layer("a", ("a/**",)), Layer("a", ("x",)), Layer("", ("y",)), Layer("empty", ()))
    assert lint(spark, [Rule("r", "a", ("gone",))], layers) == [
        ("", "layer name is required"), ("a", "duplicate layer name"), ("empty", "layer must have at least one path pattern"), ("r", "'to' references unknown layer gone"),
    ]
    assert lint(spark, [Rule("r", pattern="x")], ()) == [("", "at least one layer must be defined")]
