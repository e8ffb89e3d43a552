"""Plan shapes: no Python on hot paths, no cartesian products, pruned scans."""

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
LAZY = ("g1_coupling_matrix", "r10_override_severity", "h2_diff_runs", "h5_baseline_filter", "x_extract_all", "h13_fix_conflicts")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_products(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval"):
        assert word not in text, word


def test_columns_are_pruned(spark):
    text = plan(contract.queries()["g1_coupling_matrix"](spark, SF))
    assert "l_extendedprice" not in text and "l_linenumber" not in text and "o_totalprice" not in text
    paths = plan(contract.queries()["x20_generated_header"](spark, SF))
    assert "l_orderkey" not in paths


def test_rules_do_not_shuffle(spark):
    from strata.operators.rules import standard_violations
    from strata.sources.adapters import TRADE

    deps = spark.createDataFrame(
        [("p", "africa/x", 1, "asia/y", "infrastructure", "R")],
        "project_id string, source_file string, source_line int, import_path string, resolved_layer string, language string",
    )
    text = plan(standard_violations(deps, TRADE))
    assert "Exchange" not in text and "Join" not in text


def test_order_lines_shuffle_once_and_without_paths(spark):
    """Suppliers meet the lines as two numbers, on their file's size; paths are put together behind the last join."""
    from strata.sources.adapters import deps_from_trade

    text = plan(deps_from_trade(spark, SF))
    assert "hashpartitioning(l_suppkey" not in text and "hashpartitioning(s_suppkey" not in text


def test_a_project_is_not_one_task(spark):
    """Rows a project (module prefixes, totals) are joined on their known size, not by gathering the project."""
    import re

    from strata.operators import diffs, resolution
    from strata.sources.adapters import ALIASES, CORPUS_LAYERS

    files = spark.createDataFrame([("p", "go.mod", "module m")], "project_id string, path string, content string")
    imports = spark.createDataFrame(
        [("p", "a/x.go", 1, "m/b", "go")], "project_id string, source_file string, source_line int, import_path string, language string"
    )
    changes = spark.createDataFrame([("p", 1)], "project_id string, pr int")
    for df in (
        resolution.resolve_imports(imports, files, CORPUS_LAYERS, ALIASES),
        diffs.pr_summary(changes, imports, changes),
    ):
        assert not re.search(r"hashpartitioning\(project_id#\d+, \d+\)", plan(df))


def test_contract_shape():
    names, sqls = contract.queries(), contract.oracle_sql()
    assert set(sqls) <= set(names) and len(names) > 150


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["project_id", "rule_id", "total", "errors", "warnings", "info"] and df.count() > 0
