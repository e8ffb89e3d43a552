"""Configurations per project: the pattern index and the evaluation against the literal path."""

import random

import pytest
from pyspark.sql import functions as F

from strata.functions.globs import compile_glob, glob_match
from strata.model import Config, Layer, Override, Rule, layers_table, rules_table
from strata.operators import fleet, graph, rules
from strata.operators.corpus import ignored
from strata.operators.layers import assign_source_layer_by_table
from strata.operators.pattern_index import compiled, matching
from strata.session import materialise

GLOBS = [
    "a", "a/", "a/b", "a/b/", "a/**", "a/b/**", "**", "**/*", "**/b", "**/b/**", "a/*", "a/*/c", "a/*.go", "*.go", "a?/b", "[ab]/c", "a/[!x]c", "a/**/c", "a/**c", "a/***",
    "a*/**", "a/b*/**", "*", "a\\*", "a/[", "x/**/*.go", "x/**/b/*", "/a", "/a/**", "", "a.b", "a+(b)/**", "**a", "**/a*", "a/**/*", "a**", "*/b", "?", "b/**/", "a/b/**/d.go",
]
PATHS = [
    "a", "a/", "a/b", "a/b/c", "a/c", "ab", "ab/c", "abc", "a/b/c/d.go", "b", "x/b", "x/y/b/z", "x/main.go", "x/y/main.go", "main.go", "a/main.go", "axb", "a.b", "aXb", "/a", "/a/b",
    "a+(b)/c", "b/c", "c", "a/bc/d", "a/b/x/d.go", "a/b/d.go", "", "a/xc", "a/b/c/c", "a*", "a/[", "x/b/c", "x/q/b/c", "bc", "a/b.go/x", "z.go/y", "b/", "a//c", "a1/b",
]


@pytest.mark.parametrize("dialect", ["layer", "exclude", "ignore"])
def test_index_finds_what_literal_patterns_match(spark, dialect):
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    test = (lambda g: ignored(F.col("path"), [g])) if dialect == "ignore" else (lambda g: glob_match(F.col("path"), g, dialect))
    want = {
        (r.path, g) for r in paths.select("path", *[test(g).alias(f"g{i}") for i, g in enumerate(GLOBS)]).collect() for i, g in enumerate(GLOBS) if r[f"g{i}"]
    }
    patterns = compiled(spark.createDataFrame([("", g, dialect) for g in GLOBS], "config string, glob string, dialect string"))
    got = matching(paths.select(F.lit("").alias("config"), "path"), patterns).select("path", "glob").collect()
    assert sorted((r.path, r.glob) for r in got) == sorted(want)


def test_anchors_are_literal_directories():
    assert [compile_glob(g)[2] for g in ("a/b/**", "a/**/c", "a/**c", "a/b*/**", "**/x", "a/b", "a/*.go")] == ["a/b", "a", "", "a", "", "a", "a"]
    assert compile_glob("a/[", "layer")[0] == "prefix" and compile_glob("a/[*", "layer")[0] == "never"
    assert compile_glob("*.go", "ignore")[2] == "" and compile_glob("a/*.go", "ignore")[2] == "a"


def random_config(rng):
    folders = ["a", "b", "c", "d"]
    names = ["one", "two", "three"]
    layers = tuple(Layer(n, tuple(rng.choice(["{}/**", "{}", "{}/x*/**", "**/{}", "{}*/y"]).format(rng.choice(folders)) for _ in range(2))) for n in names)

    def rule(i):
        pattern = rng.choice(["", "", "x$", "^[ab]/"])
        bare = pattern and rng.random() < 0.5
        return Rule(
            f"r{i}", "" if bare else rng.choice(names), () if bare else tuple(rng.sample(names, 2)), rng.choice(["Cannot", "cannot", "MustNotCircular", "Can", "Must"]),
            rng.choice(["error", "warning"]), rng.choice(["", "why"]), pattern, tuple(rng.sample(["a/x/**", "b/", "c/y*", "d"], rng.randrange(3))),
            tuple(Override(rng.choice(["", "a", "a/", "a/x1", "b/x", "c/"]), rng.choice(["", "info", "error"]), rng.choice([None, True, False])) for _ in range(rng.randrange(4))),
        )

    return Config(layers, tuple(rule(i) for i in range(6)), tuple(rng.sample(["*9", "d/y/", "b/**/z"], rng.randrange(3))))


def random_deps(spark, rng, projects, n=400):
    def path():
        return "/".join([rng.choice("abcd"), *[rng.choice(["x", "x1", "y", "z", "y9", "ax"]) for _ in range(rng.randrange(3))]])

    rows = [(rng.choice(projects), path(), i, path(), None, "go") for i in range(n)]
    return spark.createDataFrame(rows, "project_id string, source_file string, source_line int, import_path string, resolved_layer string, language string")


def literal(deps, config):
    """The path with literal Columns, for one configuration."""
    from strata.functions.globs import first_match

    kept = deps.where(~ignored(F.col("source_file"), list(config.exclude))) if config.exclude else deps
    return kept.withColumn("resolved_layer", first_match(F.col("import_path"), config.layers))


@pytest.mark.parametrize("seed", [0, 7])
def test_shared_config_gives_the_literal_result(spark, rows, seed):
    rng = random.Random(seed)
    config = random_config(rng)
    deps = random_deps(spark, rng, ["p", "q", "r"])
    projects = spark.createDataFrame([("p",), ("q",), ("r",), ("none",)], "project_id string")
    given = literal(deps, config)
    want = rules.standard_violations(given, config)
    cycles = graph.layer_cycles(graph.layer_edges(rules.classified(given, config.layers)))
    want = want.unionByName(graph.circular_violations(cycles, config))
    assert rows(fleet.evaluate_fleet(deps, fleet.Fleet(config), projects)) == rows(want)
    # the same when every project sets all of it itself
    tables = [t.drop("project_id").crossJoin(projects) for t in (layers_table(spark, config.layers), rules_table(spark, config.rules))]
    settings = projects.select("project_id", F.array(*map(F.lit, config.exclude)).cast("array<string>").alias("exclude"), F.lit(3).alias("max_violations"))
    own = fleet.Fleet(Config((), (), ()), *tables, settings)
    assert rows(fleet.evaluate_fleet(deps, own, projects)) == rows(want)
    merged = fleet.merge_configs(spark, own)
    edges = fleet.classified_by_project(deps, merged)
    missing = rules.rule_must(given, config, projects)
    assert rows(fleet.missing_edges_by_project(edges, merged, projects), *missing.columns) == rows(missing)
    gate = {r.project_id: r for r in fleet.gate_by_project(want, own, projects).collect()}
    assert gate["none"].passed and gate["none"].counted == 0 and {g.allowed for g in gate.values()} == {3}


def test_fields_are_replaced_as_a_whole(spark):
    shared = Config((Layer("shared", ("shared/**",)), Layer("other", ("other/**",))), (Rule("shared-rule", "shared", ("other",)),))
    own = fleet.Fleet(
        shared,
        layers_table(spark, (Layer("override", ("override/**",)),), "p"),
        rules_table(spark, (Rule("own-rule", "other", ("shared",)),), "q"),
        spark.createDataFrame([("r", ["gone/"], None), ("s", [], 5)], fleet.SETTINGS_SCHEMA),
    )
    config = fleet.merge_configs(spark, own)
    assert sorted(r.project_id for r in config.keys.collect()) == ["p", "q", "r"]
    assert {(r.config, r.name) for r in config.layers.collect()} == {(":p", "override"), *((c, n) for c in (":q", ":r", "") for n in ("shared", "other"))}
    assert {(r.config, r.id) for r in config.rules.collect()} == {(":p", "shared-rule"), (":q", "own-rule"), (":r", "shared-rule"), ("", "shared-rule")}
    assert [tuple(r) for r in config.excludes.collect()] == [(":r", "gone/")]


def test_patterns_meet_distinct_paths_only(spark):
    deps = spark.createDataFrame([("p", "a/x", i, "b", None, "go") for i in range(50)], "project_id string, source_file string, source_line int, import_path string, resolved_layer string, language string")
    layers = layers_table(spark, (Layer("one", ("a/*",)),), "p")
    out = assign_source_layer_by_table(deps, layers)
    assert out.groupBy("source_layer").count().collect()[0].asDict() == {"source_layer": "one", "count": 50}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    confirm = plan.index("RLIKE") if "RLIKE" in plan else plan.lower().index("regexp")
    assert "Aggregate [" in plan[confirm:]  # the plan reads upwards: paths are made distinct first


def test_edges_meet_each_side_once(spark):
    """Import patterns come with the layer, so judging classified edges takes no second run over them."""
    own = fleet.Fleet(Config((Layer("a", ("a/**",)), Layer("b", ("b/**",))), (Rule("r", "a", ("b",)), Rule("p", pattern="x$"))))
    rows = [("p", f"a/{i % 7}", i, f"b/{i % 5}{'x' if i % 2 else ''}", "go") for i in range(40)]
    deps = materialise(spark.createDataFrame(rows, "project_id string, source_file string, source_line int, import_path string, language string"))
    merged = fleet.merge_configs(spark, own)
    edges = fleet.classified_by_project(deps, merged)
    found = fleet.standard_violations_by_project(edges, merged)
    assert found.count() == 60
    joins = [x._jdf.queryExecution().optimizedPlan().toString().count("Join ") for x in (edges, found)]
    assert joins[1] - joins[0] == 2  # rules by layer pair and rules by number; the edges aren't made a second time


def test_evaluation_does_not_move_the_language(spark, monkeypatch):
    deps = spark.createDataFrame(
        [("p", "a/x", 1, "b/y", "", "R")],
        "project_id string, source_file string, source_line int, import_path string, resolved_layer string, language string",
    )
    config = Config((Layer("one", ("a/**",)), Layer("two", ("b/**",))), (Rule("r", "one", ("two",)),))
    written = []
    monkeypatch.setattr(fleet, "materialise", lambda df: written.append(df.columns) or materialise(df))
    found = fleet.evaluate_fleet(deps, fleet.Fleet(config), deps.select("project_id")).collect()
    assert [(r.rule_id, r.file) for r in found] == [("r", "a/x")]
    assert any("source_layer" in c for c in written) and not any("language" in c for c in written)
