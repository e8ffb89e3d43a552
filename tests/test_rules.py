"""Rule evaluation, overrides, templates, policies and linting."""

import random

import pytest
from pyspark.sql import functions as F

from strata.model import Config, Layer, Override, Rule, fold_rule_type, layers_table, rules_table
from strata.operators import rules, templates
from strata.operators.guidance import enrich_explanation, fix_guidance, suggest_fix
from strata.plans.check import audit, evaluate_rules

LAYERS = (
    Layer("domain", ("internal/domain/**",)),
    Layer("application", ("internal/application/**",)),
    Layer("infrastructure", ("internal/infrastructure/**",)),
)
DEPS = "project_id string, source_file string, source_line int, import_path string, resolved_layer string, language string"


def deps_of(spark, *edges, project="p"):
    return spark.createDataFrame([(project, f, n, i, t, "go") for f, n, i, t in edges], DEPS)


def d(name):
    return f"internal/domain/{name}.go"


def test_cannot_and_unresolved(spark, rows):
    deps = deps_of(
        spark,
        (d("a"), 3, "x/infra", "infrastructure"),
        (d("b"), 4, "fmt", None),
        ("cmd/main.go", 5, "x/infra", "infrastructure"),
        ("internal/application/s.go", 6, "x/domain", "domain"),
    )
    config = Config(LAYERS, (Rule("no-infra", "domain", ("infrastructure",)),))
    out = rules.standard_violations(deps, config)
    assert rows(out, "rule_id", "file", "line", "message", "severity", "overridden") == [
        ("no-infra", d("a"), 3, "domain cannot depend on infrastructure (import: x/infra)", "error", False)
    ]


def test_rule_types(spark):
    deps = deps_of(spark, (d("a"), 1, "x", "infrastructure"))
    for kind, n in (("Cannot", 1), ("MustNotCircular", 1), ("Must", 0), ("Can", 0), ("custom", 0)):
        config = Config(LAYERS, (Rule("r", "domain", ("infrastructure",), kind),))
        assert rules.standard_violations(deps, config).count() == n, kind
    assert fold_rule_type("mustnotcircular") == "MustNotCircular"


def test_must_reports_projects_without_the_edge(spark, rows):
    deps = deps_of(spark, (d("a"), 1, "x", "application"), project="has")
    projects = spark.createDataFrame([("has",), ("lacks",), ("empty",)], "project_id string")
    config = Config(LAYERS, (Rule("m", "domain", ("application",), "Must"),))
    assert rows(rules.rule_must(deps, config, projects), "project_id") == [("empty",), ("lacks",)]
    assert rules.rule_must(deps, config, projects, compat=True).count() == 0


def test_pattern_rules(spark, rows):
    deps = deps_of(spark, (d("a"), 1, "db/sql", "infrastructure"), (d("b"), 2, "db/nosql", "application"))
    only = Config(LAYERS, (Rule("p", pattern="sql$"),))
    assert rules.standard_violations(deps, only).count() == 2
    both = Config(LAYERS, (Rule("p", "domain", ("infrastructure",), pattern="sql$"),))
    assert rows(rules.standard_violations(deps, both), "file") == [(d("a"),)]
    can = Config(LAYERS, (Rule("p", pattern="sql$", type="Can"),))
    assert rules.standard_violations(deps, can).count() == 0


def test_override_order_disable_exclude_severity(spark, rows):
    rule = Rule(
        "r",
        "domain",
        ("infrastructure",),
        exclude=("internal/domain/gen/",),
        overrides=(
            Override("internal/domain/", "warning"),
            Override("internal/domain/legacy", "info"),
            Override("internal/domain/off/", enabled=False),
            Override("internal/domain/off/", "info"),
            Override("internal/domain/on/", enabled=True),
        ),
    )
    names = ("a", "legacy/x", "legacyish", "off/x", "gen/x", "on/x")
    deps = deps_of(spark, *[(d(n), 1, "x", "infrastructure") for n in names])
    out = rules.standard_violations(deps, Config(LAYERS, (rule,)))
    assert rows(out, "file", "severity", "original_severity", "overridden") == [
        (d("a"), "warning", "error", True),
        (d("legacy/x"), "info", "error", True),
        (d("legacyish"), "warning", "error", True),
        (d("on/x"), "warning", "error", True),
    ]


def test_override_brute_force(spark):
    rng = random.Random(3)
    parts = ["a", "b", "c"]
    for _ in range(8):
        overrides = tuple(
            Override(
                "/".join(rng.choice(parts) for _ in range(rng.randint(0, 2))) + rng.choice(["", "/"]),
                rng.choice(["", "info", "warning"]),
                rng.choice([None, None, True, False]),
            )
            for _ in range(4)
        )
        overrides = tuple(o if o.path != "/" else Override("", o.severity, o.enabled) for o in overrides)
        rule = Rule("r", "all", ("all",), overrides=overrides)
        files = ["/".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(12)]

        def covers(path, file):
            if path == "":
                return True
            return file.startswith(path) if path.endswith("/") else file == path or file.startswith(path + "/")

        want = {}
        for f in set(files):
            if any(o.enabled is False and covers(o.path, f) for o in overrides):
                continue
            best = None
            for o in overrides:
                if o.severity and covers(o.path, f) and (best is None or len(o.path) > len(best.path)):
                    best = o
            want[f] = best.severity if best else "error"
        deps = deps_of(spark, *[(f, 1, "x", "all") for f in set(files)])
        config = Config((Layer("all", ("",)),), (rule,))
        got = {r.file: r.severity for r in rules.standard_violations(deps, config).collect()}
        assert got == want


def test_ids_are_sequential_per_project_with_copies(spark):
    deps = deps_of(spark, *[(d("a"), 1, "x", "infrastructure")] * 120, (d("b"), 1, "x", "infrastructure"))
    config = Config(LAYERS, (Rule("r", "domain", ("infrastructure",)),))
    ids = [r.id for r in rules.violation_ids(rules.standard_violations(deps, config)).collect()]
    assert sorted(ids) == sorted(f"D-{i:02d}" for i in range(1, 122))


def test_templates(spark, rows):
    deps = deps_of(spark, *[(d(str(i)), i, f"x{i}", "infrastructure") for i in range(3)], (d("z"), 9, "y", "application"))
    projects = spark.createDataFrame([("p",), ("q",)], "project_id string")
    edges = rules.assign_source_layer(deps, LAYERS)
    over = templates.tpl_max_deps(edges, LAYERS, {"from": "domain", "to": ["infrastructure"], "max": 2}, projects)
    assert rows(over, "message") == [("domain has 3 dependencies to [infrastructure] (max: 2)",)]
    at = templates.tpl_max_deps(edges, LAYERS, {"from": "domain", "to": ["infrastructure"], "max": 3}, projects)
    assert at.count() == 0
    leak = templates.tpl_no_leak(edges, LAYERS, {"layer": "domain", "forbidden": ["application"]}, projects)
    assert rows(leak, "file", "message") == [(d("z"), f"{d('z')} imports y from forbidden layer application")]
    balance = templates.tpl_layer_balance(edges, LAYERS, {"min": 1, "max": 3}, projects)
    assert rows(balance, "project_id", "message") == [
        ("p", "application has 0 dependencies (min: 1)"),
        ("p", "domain has 4 dependencies (max: 3)"),
        ("p", "infrastructure has 0 dependencies (min: 1)"),
        ("q", "application has 0 dependencies (min: 1)"),
        ("q", "domain has 0 dependencies (min: 1)"),
        ("q", "infrastructure has 0 dependencies (min: 1)"),
    ]


def test_template_parameters():
    templates.check_parameters("max-deps", {"from": "a", "to": ["b"], "max": "3"})
    templates.check_parameters("layer-balance", {"min": 1.0, "max": 2})
    for name, params in (
        ("max-deps", {"from": "a", "to": ["b"]}),
        ("max-deps", {"from": "a", "to": "b", "max": 1}),
        ("layer-balance", {"min": 1.5, "max": 2}),
        ("ghost", {}),
    ):
        with pytest.raises((ValueError, TypeError)):
            templates.check_parameters(name, params)
    with pytest.raises(ValueError):
        templates.register_template("no-leak", templates.tpl_no_leak, {})


def test_policy_isolation_and_gates(spark, rows):
    deps = deps_of(spark, (d("a"), 1, "x", "infrastructure"))
    config = Config(LAYERS)
    none = rules.standard_violations(deps, config)

    def policy(deps_, _layers, _violations, _params):
        return deps_.select("project_id", F.col("source_file").alias("file"), F.lit("m").alias("message"))

    kept, status = rules.policy_udf(policy, Rule("pol", severity="info"), deps, config, none)
    assert status == "ok" and rows(kept, "rule_id", "severity") == [("pol", "info")]
    out, _ = rules.policy_udf(policy, Rule("pol", exclude=("internal/**",)), deps, config, none)
    assert out.count() == 0
    off = Rule("pol", overrides=(Override("", enabled=False),))
    assert rules.policy_udf(policy, off, deps, config, none) == (None, "disabled")
    bad = rules.policy_udf(lambda *_: deps.select("ghost"), Rule("pol"), deps, config, none)
    assert bad[0] is None and bad[1].startswith("error")


def test_lint(spark, rows):
    layer_rows = layers_table(spark, (*LAYERS, LAYERS[0], Layer("bare", ())), "p")
    bad = (
        Rule("ok", "domain", ("application",)),
        Rule("to", "domain", ("ghost",)),
        Rule("from", "ghost", ("domain",)),
        Rule("kind", "domain", ("application",), type="Never"),
        Rule("sev", "domain", ("application",), severity="fatal"),
        Rule("empty", "", ()),
        Rule("over", "domain", ("application",), overrides=(Override("x", "fatal"),)),
        Rule("pattern", pattern="x"),
        Rule("tpl", template="no-leak", type=""),
    )
    found = rows(rules.lint_rules(rules_table(spark, bad, "p"), layer_rows), "subject", "finding")
    assert found == [
        ("bare", "layer must have at least one path pattern"),
        ("domain", "duplicate layer name"),
        ("empty", "'from' field is required"),
        ("empty", "'to' field must have at least one target"),
        ("from", "'from' references unknown layer ghost"),
        ("kind", "invalid rule type"),
        ("over", "override has invalid severity"),
        ("sev", "invalid severity"),
        ("to", "'to' references unknown layer ghost"),
    ]


def test_severity_map(spark):
    table = rules_table(spark, (Rule("r", "a", ("b",), overrides=(Override("x", "info"),)),))
    row = rules.severity_map(table, {"error": "warning", "info": "error"}).first()
    assert (row.severity, row.overrides[0].severity) == ("warning", "error")
    with pytest.raises(ValueError):
        rules.severity_map(table, {"error": "fatal"})


def test_golden_project(spark, rows):
    deps = deps_of(
        spark,
        (d("order"), 3, "m/internal/infrastructure/db", "infrastructure"),
        ("internal/infrastructure/db.go", 4, "m/internal/domain", "domain"),
        ("internal/application/s.go", 5, "m/internal/domain", "domain"),
    )
    config = Config(LAYERS, (Rule("domain-imports-infrastructure", "domain", ("infrastructure",)),))
    projects = spark.createDataFrame([("p",)], "project_id string")
    out = evaluate_rules(deps, config, projects)
    assert rows(out, "rule_id", "source_layer", "target_layer") == [
        ("domain-imports-infrastructure", "domain", "infrastructure"),
        ("no-circular-dependencies", "domain", "infrastructure"),
    ]
    report = audit(deps, config, projects)
    debt = report["debt"].first()
    assert (debt.total, debt.penalty, debt.band) == (6, 5, "good")
    assert report["gate"].first().passed is False
    assert report["fleet"].first().failed_projects == 1


def test_guidance(spark, rows):
    base = [("p", r, "domain", "infrastructure", "a/b/'Store'", "m", 7, "f") for r in
            ("domain-imports-infrastructure", "domain-x", "my-circular", "other")]
    df = spark.createDataFrame(
        base, "project_id string, rule_id string, source_layer string, target_layer string, import_path string, message string, line int, file string"
    )
    known = (Rule("domain-x"), Rule("other", explanation="own words"))
    texts = dict(rows(enrich_explanation(df, known), "rule_id", "message"))
    assert texts["other"] == "own words" and texts["my-circular"] == "m" and "domain purity" in texts["domain-x"]
    steps = {r.rule_id: r.steps for r in fix_guidance(df).collect()}
    assert "circular path" in steps["my-circular"][0] and len(steps["other"]) == 3
    fix = suggest_fix(df).where("rule_id = 'other'").first()
    assert fix.description == "Extract an interface from a/b/'Store' and inject it via constructor"
    assert fix.interface == "StoreRepository" and "@@ -7 +7 @@" in fix.diff


def test_no_check_is_skipped_in_silence(spark):
    deps = spark.createDataFrame(
        [("p", "a/x", 1, "b/y", "b", "go"), ("p", "a/gen/x", 1, "b/y", "b", "go")],
        "project_id string, source_file string, source_line int, import_path string, resolved_layer string, language string",
    )
    layers = (Layer("a", ("a/**",)), Layer("b", ("b/**",)))
    projects = deps.select("project_id").distinct()
    with pytest.raises(ValueError, match="few"):
        evaluate_rules(deps, Config(layers, (Rule("few", check="count < 3"),)), projects)
    some = Config(layers, (Rule("r", "a", ("b",)),), exclude=("gen",))
    assert [r.file for r in evaluate_rules(deps, some, projects).collect()] == ["a/x"]
