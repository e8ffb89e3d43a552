"""Queries over the trade edges: layers, rules, metrics, graph, scores."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.base import block, query
from strata.functions.globs import glob_match
from strata.model import Rule, rules_table
from strata.operators import fleet, graph, guidance, layers, linting, metrics, ordering, rules, scoring, templates
from strata.plans.check import evaluate_rules
from strata.session import materialise
from strata.sources.adapters import TRADE, deps_from_pages, deps_from_trade, places, table


def projects(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderpriority").alias("project_id")).distinct()


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The edges as a written table, for queries that read them more than once."""
    return materialise(deps_from_trade(spark, folder))


def edges(spark: SparkSession, folder: str, deps: DataFrame | None = None) -> DataFrame:
    return rules.classified(deps if deps is not None else deps_from_trade(spark, folder), TRADE.layers)


def all_edges(spark: SparkSession, folder: str, deps: DataFrame | None = None) -> DataFrame:
    return layers.assign_source_layer(deps if deps is not None else deps_from_trade(spark, folder), TRADE.layers)


def violations(spark: SparkSession, folder: str, deps: DataFrame | None = None) -> DataFrame:
    return rules.standard_violations(deps if deps is not None else deps_from_trade(spark, folder), TRADE)


def coupling(spark: SparkSession, folder: str, deps: DataFrame | None = None) -> DataFrame:
    return scoring.coupling_matrix(edges(spark, folder, deps))


def pairs(spark: SparkSession, folder: str, deps: DataFrame | None = None) -> DataFrame:
    return graph.pair_count(graph.bidirectional_pairs(coupling(spark, folder, deps)), projects(spark, folder))


def cycles(spark: SparkSession, folder: str) -> DataFrame:
    return graph.layer_cycles(graph.layer_edges(edges(spark, folder)))


def _layer_sql(p: str) -> str:
    return (
        f"CASE WHEN {p} = 'africa' OR starts_with({p}, 'africa/') THEN 'domain' "
        f"WHEN {p} = 'america' OR starts_with({p}, 'america/') THEN 'application' "
        f"WHEN {p} = 'asia' OR starts_with({p}, 'asia/') "
        f"OR regexp_matches({p}, '^europe/nation_1[^/]*(/.*)?$') THEN 'infrastructure' "
        f"WHEN {p} = 'europe' OR starts_with({p}, 'europe/') THEN 'presentation' END"
    )


block(
    "place",
    "SELECT n_nationkey, lower(replace(r_name, ' ', '_')) || '/' || lower(n_name) AS place "
    "FROM nation JOIN region ON n_regionkey = r_regionkey",
)
block(
    "t_deps",
    f"""
SELECT project_id, source_file, source_line, import_path, {_layer_sql('import_path')} AS resolved_layer, language
FROM (SELECT o_orderpriority AS project_id, sp.place || '/s' || s_suppkey AS source_file,
             l_linenumber AS source_line, cp.place || '/c' || c_custkey AS import_path, l_returnflag AS language
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN place cp ON c_nationkey = cp.n_nationkey JOIN supplier ON l_suppkey = s_suppkey
      JOIN place sp ON s_nationkey = sp.n_nationkey)
""",
)
block("t_all", f"SELECT *, {_layer_sql('source_file')} AS source_layer FROM t_deps")
block("t_edges", "SELECT * FROM t_all WHERE source_layer IS NOT NULL AND resolved_layer IS NOT NULL")
block("t_projects", "SELECT DISTINCT o_orderpriority AS project_id FROM orders")
block(
    "t_hits",
    """
SELECT *, 1 AS rule_ord, 'domain-imports-infrastructure' AS rule_id, 'error' AS base,
       CASE WHEN source_file = 'africa/nation_0/' OR starts_with(source_file, 'africa/nation_0/') THEN 'info'
            WHEN starts_with(source_file, 'africa/') THEN 'warning' END AS changed,
       source_layer || ' cannot depend on ' || resolved_layer || ' (import: ' || import_path || ')' AS message
FROM t_edges WHERE source_layer = 'domain' AND resolved_layer = 'infrastructure'
     AND NOT (source_file = 'africa/nation_10' OR starts_with(source_file, 'africa/nation_10/'))
UNION ALL
SELECT *, 2, 'application-hides-views', 'warning', NULL,
       'Keep views out: ' || source_layer || ' cannot import ' || resolved_layer
FROM t_edges WHERE source_layer = 'application' AND resolved_layer IN ('presentation', 'infrastructure')
     AND NOT regexp_matches(source_file, '^america/nation_1(/.*)?$')
     AND NOT regexp_matches(source_file, '^america/nation_6/s[^/]*1$')
UNION ALL
SELECT *, 3, 'no-hot-customers', 'info', CASE WHEN starts_with(source_file, 'europe/') THEN 'warning' END,
       source_layer || ' cannot depend on ' || resolved_layer || ' (import: ' || import_path || ')'
FROM t_edges WHERE regexp_matches(import_path, '/c[0-9]*7$')
UNION ALL
SELECT *, 4, 'presentation-legacy', 'error', NULL,
       source_layer || ' cannot depend on ' || resolved_layer || ' (import: ' || import_path || ')'
FROM t_edges WHERE source_layer = 'presentation' AND resolved_layer = 'domain'
     AND regexp_matches(import_path, 'nation_(0|5)/')
UNION ALL
SELECT *, 8, 'layer-circular', 'error', NULL,
       source_layer || ' cannot depend on ' || resolved_layer || ' (import: ' || import_path || ')'
FROM t_edges WHERE source_layer = 'domain' AND resolved_layer = 'application'
""",
)
VIOL = """project_id, rule_ord, rule_id, source_file AS file, source_line AS line, source_layer,
resolved_layer AS target_layer, import_path, message, coalesce(changed, base) AS severity,
CASE WHEN changed IS NOT NULL THEN base ELSE '' END AS original_severity, changed IS NOT NULL AS overridden"""
block("t_viol", f"SELECT {VIOL} FROM t_hits")
block(
    "t_coupling",
    "SELECT project_id, source_layer AS from_layer, resolved_layer AS to_layer, count(*) AS cnt "
    "FROM t_edges GROUP BY ALL",
)
block(
    "t_pairs",
    "SELECT a.project_id, a.from_layer AS layer_a, a.to_layer AS layer_b FROM t_coupling a JOIN t_coupling b "
    "ON a.project_id = b.project_id AND a.from_layer = b.to_layer AND a.to_layer = b.from_layer "
    "WHERE a.from_layer <= a.to_layer",
)
block(
    "t_pair_count",
    "SELECT p.project_id, count(t.project_id) AS pair_count, count(t.project_id) > 0 AS has_cycles "
    "FROM t_projects p LEFT JOIN t_pairs t USING (project_id) GROUP BY p.project_id",
)
block(
    "t_ledges",
    "SELECT project_id, source_layer, resolved_layer AS target_layer, "
    "arg_min(source_file, (source_file, source_line, import_path)) AS file, "
    "arg_min(source_line, (source_file, source_line, import_path)) AS line FROM t_edges GROUP BY 1, 2, 3",
)
block(
    "t_walk",
    """
SELECT project_id, source_layer AS start, target_layer AS tip, [source_layer, target_layer] AS nodes,
       [source_layer || ' (' || file || ':' || line || ')'] AS whys, source_layer = target_layer AS closed
FROM t_ledges WHERE source_layer <= target_layer
UNION ALL
SELECT w.project_id, w.start, e.target_layer, list_append(w.nodes, e.target_layer),
       list_append(w.whys, e.source_layer || ' (' || e.file || ':' || e.line || ')'), e.target_layer = w.start
FROM t_walk w JOIN t_ledges e ON w.project_id = e.project_id AND w.tip = e.source_layer
WHERE NOT w.closed AND (e.target_layer = w.start
      OR (e.target_layer > w.start AND NOT list_contains(w.nodes, e.target_layer)))
""",
)
block("t_every", "SELECT project_id, nodes AS cycle, list_append(whys, start) AS path FROM t_walk WHERE closed")
# the shortest cycle through each edge, ties by the names from the edge's target on
block(
    "t_cycles",
    """
SELECT DISTINCT project_id, c.cycle AS cycle, c.path AS path FROM (
  SELECT project_id, cycle[i] AS a, cycle[i + 1] AS b,
         arg_min({'cycle': cycle, 'path': path}, (len(cycle), cycle[i + 1 : len(cycle) - 1] || cycle[1 : i])) AS c
  FROM (SELECT project_id, cycle, path, unnest(range(1, len(cycle))) AS i FROM t_every) GROUP BY 1, 2, 3)
""",
)


# --- layers -------------------------------------------------------------------


@query(
    "l1_glob_match",
    """
SELECT 'src/*/x' AS pattern_kind, project_id, count(*) AS n FROM t_deps
WHERE regexp_matches(source_file, '^[^/]*/nation_2[^/]*/s[^/]*$') GROUP BY 2
UNION ALL SELECT 'exclude', project_id, count(*) FROM t_deps
WHERE source_file = 'asia' OR starts_with(source_file, 'asia/') GROUP BY 2
UNION ALL SELECT 'suffix', project_id, count(*) FROM t_deps
WHERE regexp_matches(source_file, '(^|/)nation_1[^/]*/s7[^/]*$') GROUP BY 2
UNION ALL SELECT 'prefix', project_id, count(*) FROM t_deps WHERE starts_with(source_file, 'euro') GROUP BY 2
UNION ALL SELECT 'ignore', project_id, count(*) FROM t_deps
WHERE regexp_matches(source_file, '(^|/)s[0-9]$') GROUP BY 2
""",
)
def l1(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("source_file")
    tests = {
        "src/*/x": glob_match(path, "*/nation_2*/s*"),
        "exclude": glob_match(path, "asia/", "exclude"),
        "suffix": glob_match(path, "nation_1*/s7*", "suffix"),
        "prefix": glob_match(path, "euro"),
        "ignore": glob_match(path, "**/s[0-9]", "ignore"),
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    return (
        deps_from_trade(spark, folder)
        .select("project_id", F.explode(hits).alias("pattern_kind"))
        .groupBy("pattern_kind", "project_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "l2_assign_source_layer",
    "SELECT project_id, source_file, source_line, import_path, language, source_layer, resolved_layer FROM t_all",
)
def l2(spark: SparkSession, folder: str) -> DataFrame:
    return all_edges(spark, folder).select(
        "project_id", "source_file", "source_line", "import_path", "language", "source_layer", "resolved_layer"
    )


@query(
    "l2_assign_source_layer_by_table",
    "SELECT project_id, source_layer, count(*) AS n FROM t_all GROUP BY ALL",
)
def l2_table(spark: SparkSession, folder: str) -> DataFrame:
    own = F.array(*[_layer_struct(i, layer) for i, layer in enumerate(TRADE.layers, 1)])
    per_project = projects(spark, folder).select("project_id", F.explode(own).alias("l")).select("project_id", "l.*")
    return (
        layers.assign_source_layer_by_table(deps_from_trade(spark, folder), per_project)
        .groupBy("project_id", "source_layer")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _layer_struct(i: int, layer) -> F.Column:
    return F.struct(
        F.lit(i).alias("ord"), F.lit(layer.name).alias("name"), F.array(*[F.lit(p) for p in layer.paths]).alias("paths")
    )


@query(
    "l5_layer_files",
    "SELECT project_id, source_layer AS layer, count(DISTINCT source_file) AS n_files FROM t_all "
    "WHERE source_layer IS NOT NULL GROUP BY 1, 2",
)
def l5(spark: SparkSession, folder: str) -> DataFrame:
    return layers.layer_file_counts(all_edges(spark, folder))


@query(
    "l8_resolve_projects",
    "SELECT DISTINCT place || '/s' || s_suppkey AS path FROM supplier JOIN place ON s_nationkey = n_nationkey "
    "WHERE regexp_matches(place || '/s' || s_suppkey, '^europe/[^/]*/s[^/]*$') "
    "OR place || '/s' || s_suppkey = 'asia/nation_2/s1'",
)
def l8(spark: SparkSession, folder: str) -> DataFrame:
    paths = deps_paths(spark, folder)
    return layers.resolve_projects(paths, ["europe/*/s*", "asia/nation_2/s1"])


def deps_paths(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "supplier")
        .join(places(spark, folder), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.concat("place", F.lit("/s"), F.col("s_suppkey").cast("string")).alias("path"))
    )


@query(
    "l8_unmatched_entries",
    "SELECT entry FROM (VALUES ('europe/*/s*', '^europe/[^/]*/s[^/]*$'), ('moon/*', '^moon/[^/]*$')) v(entry, rx) "
    "WHERE NOT EXISTS (SELECT 1 FROM supplier JOIN place ON s_nationkey = n_nationkey "
    "WHERE regexp_matches(place || '/s' || s_suppkey, rx))",
)
def l8_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return layers.unmatched_entries(deps_paths(spark, folder), ["europe/*/s*", "moon/*"])


@query(
    "l9_merge_config",
    "SELECT o_orderpriority AS project_id, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'X') > 0 THEN 'own/**' "
    "WHEN max(o_orderpriority) LIKE '1%' THEN 'urgent/**' ELSE 'africa/**,america/**' END AS layers, "
    "CASE WHEN max(o_orderpriority) LIKE '5%' THEN 'vendor/**' ELSE 'dist/**' END AS exclude "
    "FROM orders GROUP BY 1",
)
def l9(spark: SparkSession, folder: str) -> DataFrame:
    own = projects(spark, folder).select(
        "project_id",
        F.when(F.col("project_id").startswith("1"), F.array(F.lit("urgent/**")))
        .otherwise(F.array().cast("array<string>"))
        .alias("layers"),
        F.when(F.col("project_id").startswith("5"), F.array(F.lit("vendor/**"))).alias("exclude"),
    )
    shared = {"layers": F.array(F.lit("africa/**"), F.lit("america/**")), "exclude": F.array(F.lit("dist/**"))}
    merged = layers.merge_config(own, shared, ["layers", "exclude"])
    return merged.select(
        "project_id", F.array_join("layers", ",").alias("layers"), F.array_join("exclude", ",").alias("exclude")
    )


# --- rules --------------------------------------------------------------------


def _violation_query(name: str, where: str, fn) -> None:
    query(name, f"SELECT * FROM t_viol WHERE {where}")(lambda s, f: fn(deps_from_trade(s, f), TRADE))


_violation_query("r1_rule_cannot", "rule_ord IN (1, 2)", rules.rule_cannot)
_violation_query("r4_rule_must_not_circular_edge", "rule_ord = 8", rules.rule_must_not_circular_edge)
_violation_query("r5_rule_pattern", "rule_ord = 3", rules.rule_pattern)
_violation_query("r6_rule_pattern_layers", "rule_ord = 4", rules.rule_pattern_layers)


@query(
    "r2_rule_must",
    """
SELECT project_id, 6 AS rule_ord, 'domain-needs-account' AS rule_id, 'domain' AS source_layer, 'error' AS severity,
       'domain must depend on application' AS message
FROM t_projects p WHERE NOT EXISTS (SELECT 1 FROM t_edges e WHERE e.project_id = p.project_id
     AND source_layer = 'domain' AND resolved_layer = 'application' AND regexp_matches(import_path, '/c1[0-9]1$'))
UNION ALL
SELECT project_id, 7, 'presentation-needs-adapters', 'presentation', 'error',
       'presentation must depend on infrastructure'
FROM t_projects p WHERE NOT EXISTS (SELECT 1 FROM t_edges e WHERE e.project_id = p.project_id
     AND source_layer = 'presentation' AND resolved_layer = 'infrastructure')
""",
)
def r2(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rule_must(deps_from_trade(spark, folder), TRADE, projects(spark, folder))


@query(
    "r3_rule_can",
    "SELECT project_id, source_file AS file, source_line AS line, import_path, 'info' AS severity, false AS is_violation "
    "FROM t_edges WHERE source_layer = 'infrastructure' AND resolved_layer = 'domain'",
)
def r3(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rule_can(deps_from_trade(spark, folder), TRADE).select(
        "project_id", "file", "line", "import_path", "severity", "is_violation"
    )


@query("r7_skip_unresolved", "SELECT project_id, count(*) AS kept FROM t_edges GROUP BY 1")
def r7(spark: SparkSession, folder: str) -> DataFrame:
    return edges(spark, folder).groupBy("project_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "r8_override_disable",
    "SELECT source_file, count(*) AS n FROM t_edges WHERE source_layer = 'domain' AND "
    "(source_file = 'africa/nation_10' OR starts_with(source_file, 'africa/nation_10/')) GROUP BY 1",
)
def r8(spark: SparkSession, folder: str) -> DataFrame:
    rule = TRADE.rules[0]
    off = edges(spark, folder).where((F.col("source_layer") == "domain") & rules.override_disable(rule, F.col("source_file")))
    return off.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


@query(
    "r9_rule_exclude",
    "SELECT source_file, count(*) AS n FROM t_edges WHERE source_layer = 'application' AND "
    "(regexp_matches(source_file, '^america/nation_1(/.*)?$') OR regexp_matches(source_file, '^america/nation_6/s[^/]*1$')) "
    "GROUP BY 1",
)
def r9(spark: SparkSession, folder: str) -> DataFrame:
    rule = TRADE.rules[1]
    out = edges(spark, folder).where((F.col("source_layer") == "application") & rules.rule_exclude(rule, F.col("source_file")))
    return out.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


@query(
    "r10_override_severity",
    "SELECT project_id, rule_id, severity, original_severity, overridden, count(*) AS n FROM t_viol GROUP BY ALL",
)
def r10(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["project_id", "rule_id", "severity", "original_severity", "overridden"]
    return violations(spark, folder).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "r11_severity_map",
    "SELECT v.project_id, v.rule_id, CASE base WHEN 'error' THEN 'warning' WHEN 'info' THEN 'error' ELSE base END AS severity, "
    "count(*) AS n FROM (SELECT project_id, rule_id, base FROM t_hits) v GROUP BY ALL",
)
def r11(spark: SparkSession, folder: str) -> DataFrame:
    mapped = rules.severity_map(rules_table(spark, TRADE.rules), {"error": "warning", "info": "error"})
    counts = violations(spark, folder).groupBy("project_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(mapped.select(F.col("id").alias("rule_id"), "severity"), "rule_id").select(
        "project_id", "rule_id", "severity", "n"
    )


@query("r12_violation_message", "SELECT project_id, message, count(*) AS n FROM t_viol GROUP BY ALL")
def r12(spark: SparkSession, folder: str) -> DataFrame:
    return violations(spark, folder).groupBy("project_id", "message").agg(F.count(F.lit(1)).alias("n"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TRADE_EXPLAINED = {
    "domain-imports-infrastructure": guidance.EXPLANATIONS["domain-imports-infrastructure"],
    "application-hides-views": "Keep views out",
    "no-hot-customers": guidance.EXPLANATIONS["default"],
    "presentation-legacy": guidance.EXPLANATIONS["default"],
    "layer-circular": guidance.EXPLANATIONS["layer-circular"],
}


@query(
    "r13_enrich_explanation",
    "SELECT project_id, rule_id, CASE rule_id "
    + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in _TRADE_EXPLAINED.items())
    + " END AS message, count(*) AS n FROM t_viol GROUP BY ALL",
)
def r13(spark: SparkSession, folder: str) -> DataFrame:
    rich = guidance.enrich_explanation(violations(spark, folder), TRADE.rules)
    return rich.groupBy("project_id", "rule_id", "message").agg(F.count(F.lit(1)).alias("n"))


_STEPS = {
    "domain-imports-infrastructure": "domain-imports-infrastructure",
    "application-hides-views": "application-*",
    "no-hot-customers": "default",
    "presentation-legacy": "default",
    "layer-circular": "layer-circular",
}


@query(
    "r14_fix_guidance",
    "SELECT rule_id, source_layer, target_layer, CASE rule_id "
    + " ".join(f"WHEN {_text(k)} THEN {_text(' | '.join(guidance.GUIDANCE[v]))}" for k, v in _STEPS.items())
    + " END AS steps, CASE source_layer || '-' || target_layer "
    + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in guidance.PAIR_CONTEXT.items() if k != "circular")
    + f" ELSE {_text(guidance.OTHER_PAIR)} END AS context, CASE source_layer || '-' || target_layer "
    + " ".join(f"WHEN {_text(k)} THEN {_text(' | '.join(v))}" for k, v in guidance.PAIR_STEPS.items() if k != "circular")
    + " ELSE '' END AS pair_steps, count(*) AS n FROM t_viol GROUP BY ALL",
)
def r14(spark: SparkSession, folder: str) -> DataFrame:
    rich = guidance.fix_guidance(violations(spark, folder))
    rich = rich.withColumns({"steps": F.array_join("steps", " | "), "pair_steps": F.array_join("pair_steps", " | ")})
    keys = ["rule_id", "source_layer", "target_layer", "steps", "context", "pair_steps"]
    return rich.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "r15_violation_ids",
    """
SELECT project_id, rule_id, file, line, import_path,
       'D-' || CASE WHEN n < 100 THEN lpad(n::VARCHAR, 2, '0') ELSE n::VARCHAR END AS id
FROM (SELECT *, row_number() OVER (PARTITION BY project_id
      ORDER BY rule_ord, file, line, import_path, source_layer, target_layer, message, severity) AS n FROM t_viol)
""",
)
def r15(spark: SparkSession, folder: str) -> DataFrame:
    return rules.violation_ids(violations(spark, folder)).select(
        "project_id", "rule_id", "file", "line", "import_path", "id"
    )


@query(
    "r16_tpl_max_deps",
    """
SELECT project_id, 'domain has ' || count(*) || ' dependencies to [application infrastructure] (max: 780)' AS message
FROM t_all WHERE source_layer = 'domain' AND resolved_layer IN ('application', 'infrastructure')
GROUP BY project_id HAVING count(*) > 780
""",
)
def r16(spark: SparkSession, folder: str) -> DataFrame:
    params = {"from": "domain", "to": ["application", "infrastructure"], "max": 780}
    return templates.tpl_max_deps(all_edges(spark, folder), TRADE.layers, params, projects(spark, folder)).select(
        "project_id", "message"
    )


@query(
    "r17_tpl_no_leak",
    """
SELECT project_id, source_file AS file, source_line AS line, import_path,
       source_file || ' imports ' || import_path || ' from forbidden layer ' || resolved_layer AS message
FROM t_all WHERE source_layer = 'domain' AND resolved_layer IN ('presentation', 'infrastructure')
""",
)
def r17(spark: SparkSession, folder: str) -> DataFrame:
    params = {"layer": "domain", "forbidden": ["presentation", "infrastructure"]}
    return templates.tpl_no_leak(all_edges(spark, folder), TRADE.layers, params, projects(spark, folder)).select(
        "project_id", "file", "line", "import_path", "message"
    )


@query(
    "r18_tpl_layer_balance",
    """
WITH RECURSIVE g AS (SELECT project_id, layer, coalesce(n, 0) AS n
  FROM (SELECT project_id, layer FROM (SELECT DISTINCT o_orderpriority AS project_id FROM orders),
        (VALUES ('domain'), ('application'), ('infrastructure'), ('presentation')) v(layer)) grid
  LEFT JOIN (SELECT project_id, source_layer AS layer, count(*) AS n FROM (
      SELECT o_orderpriority AS project_id, p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (
        SELECT s_suppkey, lower(replace(r_name, ' ', '_')) || '/' || lower(n_name) || '/s' || s_suppkey AS p
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
      ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey) x, LATERAL (SELECT """
    + _layer_sql("p")
    + """ AS source_layer) y WHERE source_layer IS NOT NULL GROUP BY 1, 2) c USING (project_id, layer))
SELECT project_id, layer AS source_layer, layer || ' has ' || n || ' dependencies (min: 2000)' AS message FROM g WHERE n < 2000
UNION ALL
SELECT project_id, layer, layer || ' has ' || n || ' dependencies (max: 2500)' FROM g WHERE n > 2500
""",
)
def r18(spark: SparkSession, folder: str) -> DataFrame:
    params = {"min": 2000, "max": 2500}
    return templates.tpl_layer_balance(all_edges(spark, folder), TRADE.layers, params, projects(spark, folder)).select(
        "project_id", "source_layer", "message"
    )


@query(
    "r19_policy_udf",
    "SELECT project_id, 'busy-files' AS rule_id, source_file AS file, 'too many imports: ' || count(*) AS message, "
    "'warning' AS severity FROM t_deps WHERE NOT starts_with(source_file, 'asia/nation_2/') "
    "GROUP BY project_id, source_file HAVING count(*) > 100",
)
def r19(spark: SparkSession, folder: str) -> DataFrame:
    def busy(deps, _layers, _violations, params):
        counts = deps.groupBy("project_id", F.col("source_file").alias("file")).agg(F.count(F.lit(1)).alias("n"))
        return counts.where(F.col("n") > params["most"]).select(
            "project_id", "file", F.concat(F.lit("too many imports: "), F.col("n").cast("string")).alias("message")
        )

    rule = Rule("busy-files", severity="warning", params={"most": 100}, exclude=("asia/nation_2/",))
    deps = deps_from_trade(spark, folder)
    rows, status = rules.policy_udf(busy, rule, deps, TRADE, violations(spark, folder))
    if rows is None:
        raise RuntimeError(status)
    return rows


_COUNTS = """(SELECT d.project_id, d.n AS n_deps, coalesce(v.n, 0) AS n_violations
FROM (SELECT project_id || ':' || source_file AS project_id, count(*) AS n FROM t_deps GROUP BY 1) d
LEFT JOIN (SELECT project_id || ':' || file AS project_id, count(*) AS n FROM t_viol GROUP BY 1) v
USING (project_id))"""


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    """All edges and violations, every file judged as a project of its own."""

    def keyed(df: DataFrame, file: str) -> DataFrame:
        return df.withColumn("project_id", F.concat("project_id", F.lit(":"), file))

    deps = stored(spark, folder)
    own = keyed(deps, "source_file")
    return rules.project_counts(own, keyed(violations(spark, folder, deps), "file"), own)


@query(
    "r20_policy_symmetry",
    "SELECT project_id, 'dependency-symmetry: violations with no deps indicates asymmetry' AS message FROM "
    + _COUNTS
    + " WHERE n_violations > 0 AND n_deps = 0",
)
def r20a(spark: SparkSession, folder: str) -> DataFrame:
    return rules.policy_symmetry(_counts(spark, folder))


@query(
    "r20_policy_balance",
    "SELECT project_id, 'layer-balance: deps/layer ratio too high' AS message FROM "
    + _COUNTS
    + " WHERE n_deps > 40",
)
def r20b(spark: SparkSession, folder: str) -> DataFrame:
    return rules.policy_balance(_counts(spark, folder), len(TRADE.layers))


@query(
    "r20_policy_leak",
    "SELECT project_id, 'no-leak: deps exist without any violations — potential leak' AS message FROM "
    + _COUNTS
    + " WHERE n_deps > 0 AND n_violations = 0",
)
def r20c(spark: SparkSession, folder: str) -> DataFrame:
    return rules.policy_leak(_counts(spark, folder))


_CIRCULAR_TEXT = (
    ". This creates tightly coupled code that is hard to test, modify, and deploy. "
    "Break the cycle by extracting shared abstractions or using dependency injection."
)
block(
    "t_circ",
    f"""
SELECT project_id, rule_ord, rule_id, regexp_extract(path[1], '\\((.*):[0-9]+\\)$', 1) AS file,
       regexp_extract(path[1], ':([0-9]+)\\)$', 1)::INT AS line, cycle[1] AS source_layer,
       cycle[-2] AS target_layer, 'circular: ' || array_to_string(cycle, ' → ') AS import_path,
       'Circular dependency detected: ' || array_to_string(cycle, ' → ') || '{_CIRCULAR_TEXT}' AS message,
       severity, '' AS original_severity, false AS overridden
FROM t_cycles, (VALUES (4, 'presentation-legacy', 'presentation', 'domain', 'error'),
                       (8, 'layer-circular', 'domain', 'application', 'error')) r(rule_ord, rule_id, f, t, severity)
WHERE list_contains(cycle, f) AND list_contains(cycle, t)
""",
)


@query("r21_evaluate_rules", "SELECT * FROM t_viol UNION ALL SELECT * FROM t_circ")
def r21(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate_rules(deps_from_trade(spark, folder), TRADE, projects(spark, folder))


@query(
    "r22_lint_rules",
    """
SELECT 'g' || s_nationkey AS project_id, 'to-s' || s_suppkey AS subject,
       chr(39) || 'to' || chr(39) || ' references unknown layer s' || s_suppkey AS finding
FROM supplier WHERE s_acctbal <= 0
UNION ALL SELECT 'g' || s_nationkey, 'to-s' || s_suppkey, chr(39) || 'from' || chr(39) || ' references unknown layer core'
FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM supplier t WHERE t.s_nationkey = s.s_nationkey AND t.s_suppkey % 5 = 0)
UNION ALL SELECT 'g' || s_nationkey, 'to-s' || s_suppkey, 'invalid severity' FROM supplier WHERE s_suppkey % 7 = 0
UNION ALL SELECT 'g' || s_nationkey, 'core', 'duplicate layer name' FROM supplier WHERE s_suppkey % 5 = 0
GROUP BY s_nationkey HAVING count(*) > 1
""",
)
def r22(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier")
    key = F.col("s_suppkey")
    project = F.concat(F.lit("g"), F.col("s_nationkey").cast("string")).alias("project_id")
    name = F.concat(F.lit("s"), key.cast("string"))
    rule_rows = supplier.select(
        project,
        F.concat(F.lit("to-"), name).alias("id"),
        F.lit("core").alias("from_layer"),
        F.array(name).alias("to_layers"),
        F.lit("Cannot").alias("type"),
        F.when(key % 7 == 0, "fatal").otherwise("error").alias("severity"),
        F.lit("").alias("pattern"),
        F.lit("").alias("template"),
        F.array().cast("array<struct<path:string,severity:string,enabled:boolean>>").alias("overrides"),
    )
    paths = F.array(F.lit("x/**")).alias("paths")
    layer_rows = (
        supplier.where("s_acctbal > 0")
        .select(project, name.alias("name"), paths)
        .unionByName(supplier.where(key % 5 == 0).select(project, F.lit("core").alias("name"), paths))
    )
    return rules.lint_rules(rule_rows, layer_rows)


@query(
    "p2_register_template",
    "SELECT project_id, source_file AS file, 'stale import ' || import_path AS message, count(*) AS n FROM t_deps "
    "WHERE language = 'R' AND source_line = 7 GROUP BY ALL",
)
def p2(spark: SparkSession, folder: str) -> DataFrame:
    def stale(edge_rows, _layers, params, _projects):
        hit = edge_rows.where((F.col("language") == params["flag"]) & (F.col("source_line") == int(params["line"])))
        return hit.select(
            "project_id",
            F.col("source_file").alias("file"),
            F.col("source_line").alias("line"),
            F.lit("").alias("source_layer"),
            F.lit("").alias("target_layer"),
            "import_path",
            F.concat(F.lit("stale import "), "import_path").alias("message"),
        )

    if "stale" not in templates.REGISTRY:
        templates.register_template("stale", stale, {"flag": "string", "line": "int"})
    rule = Rule("stale", template="stale", params={"flag": "R", "line": 7})
    rows = templates.apply_template(all_edges(spark, folder), TRADE.layers, 1, rule, projects(spark, folder))
    return rows.groupBy("project_id", "file", "message").agg(F.count(F.lit(1)).alias("n"))


# --- metrics ------------------------------------------------------------------


def _metric_query(name: str, sql: str, columns) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return metrics.evaluate_metrics(all_edges(spark, folder), projects(spark, folder), columns())

    query(name, sql)(run)


def _per_project(select: str) -> str:
    return f"SELECT p.project_id, {select} FROM t_projects p LEFT JOIN t_all e USING (project_id) GROUP BY p.project_id"


_D_I = "source_layer = 'domain' AND resolved_layer = 'infrastructure'"
_metric_query(
    "e1_expr_count",
    _per_project(f"count(*) FILTER (WHERE {_D_I}) AS domain_infra, count(*) FILTER (WHERE resolved_layer = 'domain') AS into_domain"),
    lambda: {
        "domain_infra": metrics.expr_count(metrics.expr_deps("domain", "infrastructure")),
        "into_domain": metrics.expr_count(F.col("resolved_layer") == "domain"),
    },
)
_metric_query(
    "e5_expr_files",
    _per_project("count(DISTINCT source_file) FILTER (WHERE source_layer = 'domain') AS domain_files, "
                 "count(DISTINCT source_file) FILTER (WHERE source_layer = 'ghost') AS ghost_files"),
    lambda: {"domain_files": metrics.expr_files("domain"), "ghost_files": metrics.expr_files("ghost")},
)
_metric_query(
    "e9_expr_all",
    _per_project(f"count(*) FILTER (WHERE {_D_I}) > 0 AS holds"),
    lambda: {"holds": metrics.expr_all(metrics.expr_deps("domain", "infrastructure"))},
)
_metric_query(
    "e10_expr_any",
    _per_project("count(*) FILTER (WHERE source_layer = 'domain' AND resolved_layer = 'ghost') > 0 AS holds"),
    lambda: {"holds": metrics.expr_any(metrics.expr_deps("domain", "ghost"))},
)
_metric_query(
    "e11_expr_filter",
    _per_project(f"count(*) FILTER (WHERE {_D_I} AND source_line >= 5) AS late, "
                 f"count(*) FILTER (WHERE {_D_I} AND source_file <> 'africa/nation_0/s1') AS others"),
    lambda: {
        "late": metrics.expr_count(metrics.expr_filter(metrics.expr_deps("domain", "infrastructure"), "SourceLine >= 5")),
        "others": metrics.expr_count(
            metrics.expr_filter(metrics.expr_deps("domain", "infrastructure"), "SourceFile != africa/nation_0/s1")
        ),
    },
)


@query(
    "e2_expr_deps",
    f"SELECT project_id, source_file, source_line, import_path FROM t_all WHERE {_D_I}",
)
def e2(spark: SparkSession, folder: str) -> DataFrame:
    return all_edges(spark, folder).where(metrics.expr_deps("domain", "infrastructure")).select(
        "project_id", "source_file", "source_line", "import_path"
    )


def _with_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.evaluate_metrics(
        all_edges(spark, folder),
        projects(spark, folder),
        {
            "a": metrics.expr_count(metrics.expr_deps("domain", "infrastructure")),
            "b": metrics.expr_count(metrics.expr_deps("domain", "application")),
            "none": metrics.expr_count(metrics.expr_deps("domain", "ghost")),
        },
    )


block(
    "t_ab",
    _per_project(
        f"count(*) FILTER (WHERE {_D_I}) AS a, "
        "count(*) FILTER (WHERE source_layer = 'domain' AND resolved_layer = 'application') AS b, "
        "count(*) FILTER (WHERE source_layer = 'domain' AND resolved_layer = 'ghost') AS none"
    ),
)


@query("e3_expr_layers", "SELECT project_id, CAST(4 AS BIGINT) AS n_layers, a > 4 AS more_than_layers FROM t_ab")
def e3(spark: SparkSession, folder: str) -> DataFrame:
    n = metrics.expr_layers(TRADE.layers)
    return _with_counts(spark, folder).select(
        "project_id", n.alias("n_layers"), metrics.expr_compare(F.col("a"), ">", n).alias("more_than_layers")
    )


@query(
    "e4_expr_has_circular",
    "SELECT project_id, EXISTS (SELECT 1 FROM t_cycles c WHERE c.project_id = p.project_id) AS has_circular FROM t_projects p",
)
def e4(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.expr_has_circular(cycles(spark, folder), projects(spark, folder))


@query(
    "e6_expr_ratio",
    "SELECT project_id, (a * 10) // b AS ratio, CAST(0 AS BIGINT) AS by_zero FROM t_ab",
)
def e6(spark: SparkSession, folder: str) -> DataFrame:
    return _with_counts(spark, folder).select(
        "project_id",
        metrics.expr_ratio(F.col("a") * 10, F.col("b")).alias("ratio"),
        metrics.expr_ratio(F.col("a"), F.col("none")).alias("by_zero"),
    )


@query(
    "e7_expr_violations",
    "SELECT p.project_id, count(*) FILTER (WHERE rule_id = 'no-hot-customers') AS hot, "
    "count(*) FILTER (WHERE rule_id = 'ghost') AS ghost FROM t_projects p LEFT JOIN t_viol v USING (project_id) GROUP BY 1",
)
def e7(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.expr_violations(
        violations(spark, folder), projects(spark, folder), {"hot": "no-hot-customers", "ghost": "ghost"}
    )


@query("e8_expr_threshold", "SELECT project_id, a >= 100 AND a <= 700 AS within FROM t_ab")
def e8(spark: SparkSession, folder: str) -> DataFrame:
    return _with_counts(spark, folder).select("project_id", metrics.expr_threshold(F.col("a"), 100, 700).alias("within"))


@query(
    "e12_expr_map",
    f"SELECT project_id, source_line::VARCHAR AS value FROM t_all WHERE {_D_I}",
)
def e12(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.expr_map(all_edges(spark, folder), metrics.expr_deps("domain", "infrastructure"), "SourceLine")


@query(
    "e13_expr_compare",
    "SELECT project_id, a = b AS eq, a <> b AS ne, a < b AS lt, a <= b AS le, a > b AS gt, a >= b AS ge FROM t_ab",
)
def e13(spark: SparkSession, folder: str) -> DataFrame:
    names = {"==": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
    return _with_counts(spark, folder).select(
        "project_id", *[metrics.expr_compare(F.col("a"), op, F.col("b")).alias(n) for op, n in names.items()]
    )


@query(
    "e14_expr_logic",
    "SELECT project_id, a > 0 AND none > 0 AS both_hold, a > 0 OR none > 0 AS either_holds, NOT none > 0 AS none_holds FROM t_ab",
)
def e14(spark: SparkSession, folder: str) -> DataFrame:
    a, none = metrics.truthy(F.col("a")), metrics.truthy(F.col("none"))
    return _with_counts(spark, folder).select(
        "project_id",
        metrics.expr_and(a, none).alias("both_hold"),
        (a | none).alias("either_holds"),
        (~none).alias("none_holds"),
    )


@query("e15_expr_function", "SELECT project_id, a + b AS leaks, (a + b) * 2 AS weighted FROM t_ab")
def e15(spark: SparkSession, folder: str) -> DataFrame:
    functions = metrics.Functions()
    functions.define("leaks", lambda _: F.col("a") + F.col("b"))
    functions.define("weighted", lambda f: f("leaks") * 2)
    return _with_counts(spark, folder).select(
        "project_id", functions("leaks").alias("leaks"), functions("weighted").alias("weighted")
    )


@query(
    "e16_expr_rule",
    "SELECT project_id, 'too-leaky' AS rule_id, 'domain leaks' AS message, 'error' AS severity FROM t_ab WHERE a > b "
    "UNION ALL SELECT project_id, 'unused', 'Expression check failed: unused', 'info' FROM t_ab WHERE none = 0",
)
def e16(spark: SparkSession, folder: str) -> DataFrame:
    checks = [
        (1, "too-leaky", F.col("a") > F.col("b"), "error", "domain leaks"),
        (2, "unused", F.col("none") == 0, "info", ""),
    ]
    return metrics.expr_rule(_with_counts(spark, folder), checks).select("project_id", "rule_id", "message", "severity")


# --- graph --------------------------------------------------------------------


@query("f1_layer_edges", "SELECT * FROM t_ledges")
def f1(spark: SparkSession, folder: str) -> DataFrame:
    return graph.layer_edges(edges(spark, folder))


@query(
    "f2_layer_cycles",
    "SELECT project_id, array_to_string(cycle, '>') AS cycle, array_to_string(path, ' | ') AS path FROM t_cycles",
)
def f2(spark: SparkSession, folder: str) -> DataFrame:
    return cycles(spark, folder).select(
        "project_id", F.array_join("cycle", ">").alias("cycle"), F.array_join("path", " | ").alias("path")
    )


@query(
    "f3_canonical_cycle",
    "SELECT project_id, array_to_string(cycle, '>') AS cycle, CAST(len(cycle) - 1 AS INT) AS n_nodes FROM t_cycles",
)
def f3(spark: SparkSession, folder: str) -> DataFrame:
    # every rotation of every cycle goes in; one canonical form comes out
    found = cycles(spark, folder)
    ring = F.slice(F.col("cycle"), F.lit(1), F.size("cycle") - 1)
    turns = F.transform(
        F.sequence(F.lit(1), F.size(ring)),
        lambda k: F.concat(F.slice(ring, k, F.size(ring)), F.slice(ring, F.lit(1), k - 1), F.slice(ring, k, F.lit(1))),
    )
    rotated = found.select("project_id", F.explode(turns).alias("cycle"))
    return graph.canonical_cycle(rotated).select("project_id", F.array_join("cycle", ">").alias("cycle"), "n_nodes")


@query("f4_circular_violations", "SELECT * FROM t_circ")
def f4(spark: SparkSession, folder: str) -> DataFrame:
    return graph.circular_violations(cycles(spark, folder), TRADE)


@query("f5_bidirectional_pairs", "SELECT project_id, layer_a, layer_b FROM t_pairs")
def f5(spark: SparkSession, folder: str) -> DataFrame:
    return graph.bidirectional_pairs(coupling(spark, folder))


@query("f6_pair_count", "SELECT project_id, pair_count, has_cycles FROM t_pair_count")
def f6(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder)


@query(
    "f7_graph_layer_export",
    "SELECT c.project_id, from_layer AS source_layer, to_layer AS target_layer, cnt, EXISTS (SELECT 1 FROM t_viol v "
    "WHERE v.project_id = c.project_id AND v.source_layer = from_layer AND v.target_layer = to_layer) AS is_violation "
    "FROM t_coupling c WHERE from_layer <> to_layer",
)
def f7(spark: SparkSession, folder: str) -> DataFrame:
    deps = stored(spark, folder)
    return graph.graph_layer_export(edges(spark, folder, deps), violations(spark, folder, deps))


@query(
    "f8_graph_file_nodes",
    "SELECT project_id, source_layer AS layer, source_file AS node, regexp_extract(source_file, '[^/]*$') AS label FROM t_all "
    "WHERE source_layer IS NOT NULL UNION SELECT project_id, resolved_layer, import_path, "
    "regexp_extract(import_path, '[^/]*$') FROM t_all WHERE resolved_layer IS NOT NULL",
)
def f8_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.graph_file_nodes(all_edges(spark, folder))


@query(
    "f8_graph_file_edges",
    """
SELECT e.*, v.file IS NOT NULL AS is_violation FROM (
  SELECT project_id, source_file, import_path, resolved_layer AS target_layer, count(*) AS cnt
  FROM t_all WHERE resolved_layer IS NOT NULL GROUP BY 1, 2, 3, 4) e
LEFT JOIN (SELECT DISTINCT project_id, file, target_layer FROM t_viol) v
ON v.project_id = e.project_id AND v.file = e.source_file AND v.target_layer = e.target_layer
""",
)
def f8_edges(spark: SparkSession, folder: str) -> DataFrame:
    deps = stored(spark, folder)
    return graph.graph_file_edges(all_edges(spark, folder, deps), violations(spark, folder, deps))


# --- scores -------------------------------------------------------------------


@query("g1_coupling_matrix", "SELECT * FROM t_coupling")
def g1(spark: SparkSession, folder: str) -> DataFrame:
    return coupling(spark, folder)


@query(
    "g2_coupling_pct",
    "SELECT project_id, from_layer, to_layer, cnt, round(cnt * 100.0 / sum(cnt) OVER (PARTITION BY project_id), 6)::DOUBLE AS pct FROM t_coupling",
)
def g2(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.coupling_pct(coupling(spark, folder)).withColumn("pct", F.round("pct", 6))


@query("g3_coupling_total", "SELECT project_id, sum(cnt)::BIGINT AS total FROM t_coupling GROUP BY 1")
def g3(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.coupling_total(coupling(spark, folder))


@query(
    "g3_coupling_get",
    "SELECT project_id, coalesce(sum(cnt) FILTER (WHERE from_layer = 'domain' AND to_layer = 'infrastructure'), 0)::BIGINT AS cnt "
    "FROM t_coupling GROUP BY 1",
)
def g3_get(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.coupling_get(coupling(spark, folder), "domain", "infrastructure")


@query(
    "g4_coupling_pivot",
    "SELECT project_id, from_layer, "
    + ", ".join(
        f"coalesce(sum(cnt) FILTER (WHERE to_layer = '{n}'), 0)::BIGINT AS {n}"
        for n in ("application", "domain", "infrastructure", "presentation")
    )
    + " FROM t_coupling GROUP BY 1, 2",
)
def g4(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.coupling_pivot(coupling(spark, folder), [ly.name for ly in TRADE.layers])


@query(
    "g5_coupling_band",
    """
SELECT project_id, from_layer, to_layer, cnt, CASE WHEN cnt > 10 THEN 'high' WHEN cnt > 5 THEN 'medium' ELSE '' END AS band,
       CASE WHEN pct <= 5 THEN 'low' WHEN pct <= 15 THEN 'medium' ELSE 'high' END AS pct_band
FROM (SELECT *, cnt * 100.0 / sum(cnt) OVER (PARTITION BY project_id) AS pct FROM t_coupling)
""",
)
def g5(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.coupling_band(scoring.coupling_pct(coupling(spark, folder))).drop("pct")


@query(
    "g6_layer_stats",
    """
SELECT project_id, layer, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming, (sum(i) - sum(o))::BIGINT AS net,
       sum(o) > sum(i) AS source_heavy, sum(i) > sum(o) AS target_heavy
FROM (SELECT project_id, from_layer AS layer, CASE WHEN from_layer <> to_layer THEN cnt ELSE 0 END AS o, 0 AS i FROM t_coupling
      UNION ALL SELECT project_id, to_layer, 0, CASE WHEN from_layer <> to_layer THEN cnt ELSE 0 END FROM t_coupling) GROUP BY 1, 2
""",
)
def g6(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.layer_stats(coupling(spark, folder))


_SEV = (
    "count(*) AS total, count(*) FILTER (WHERE severity NOT IN ('warning', 'info')) AS errors, "
    "count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS info"
)


@query("g7_severity_counts", f"SELECT project_id, rule_id, {_SEV} FROM t_viol GROUP BY 1, 2")
def g7(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.severity_counts(violations(spark, folder), ["project_id", "rule_id"])


_DEBT = """SELECT p.project_id, count(*) FILTER (WHERE severity = 'error') AS errors,
count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS info,
count(*) FILTER (WHERE severity = 'error') * 3 + count(*) FILTER (WHERE severity = 'warning') AS total,
max(pair_count) * 5 AS penalty FROM t_pair_count p LEFT JOIN t_viol v USING (project_id) GROUP BY 1"""


@query("g8_debt_score", _DEBT)
def g8(spark: SparkSession, folder: str) -> DataFrame:
    deps = stored(spark, folder)
    return scoring.debt_score(violations(spark, folder, deps), pairs(spark, folder, deps))


@query(
    "g9_violation_breakdown",
    "SELECT project_id, 'file' AS kind, file AS key, count(*) AS cnt FROM t_viol GROUP BY 1, 3 "
    "UNION ALL SELECT project_id, 'rule', rule_id, count(*) FROM t_viol GROUP BY 1, 3 "
    "UNION ALL SELECT project_id, 'pair', source_layer || ' → ' || target_layer, count(*) FROM t_viol GROUP BY 1, 3",
)
def g9(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.violation_breakdown(violations(spark, folder))


@query(
    "g9_affected",
    "SELECT project_id, count(*) AS total, count(DISTINCT file) AS files_affected, count(DISTINCT rule_id) AS rules_violated FROM t_viol GROUP BY 1",
)
def g9_totals(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.affected(scoring.violation_breakdown(violations(spark, folder)))


@query(
    "g10_debt_band",
    f"SELECT project_id, total, CASE WHEN total > 50 THEN 'poor' WHEN total > 20 THEN 'moderate' ELSE 'good' END AS band FROM ({_DEBT})",
)
def g10(spark: SparkSession, folder: str) -> DataFrame:
    deps = stored(spark, folder)
    debt = scoring.debt_score(violations(spark, folder, deps), pairs(spark, folder, deps))
    return scoring.debt_band(debt).select("project_id", "total", "band")


@query(
    "g12_run_metrics",
    "SELECT project_id, count(DISTINCT source_file) AS files, count(*) AS total_deps, count(DISTINCT language) AS detectors_run FROM t_deps GROUP BY 1",
)
def g12(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.run_metrics(deps_from_trade(spark, folder))


@query(
    "g15_gate",
    "SELECT p.project_id, count(*) FILTER (WHERE NOT overridden) AS counted, count(*) FILTER (WHERE NOT overridden) <= 1300 AS passed "
    "FROM t_projects p LEFT JOIN t_viol v USING (project_id) GROUP BY 1",
)
def g15(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.gate(violations(spark, folder), projects(spark, folder), 1300)


_REPORT = f"""SELECT p.project_id, '' AS error, count(v.rule_id) AS total,
count(*) FILTER (WHERE severity NOT IN ('warning', 'info')) AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings,
count(*) FILTER (WHERE severity = 'info') AS info, CASE WHEN count(v.rule_id) > 0 THEN 'fail' ELSE 'pass' END AS status
FROM t_projects p LEFT JOIN t_viol v USING (project_id) GROUP BY 1"""


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.project_report(violations(spark, folder), projects(spark, folder))


@query("g16_project_report", _REPORT)
def g16(spark: SparkSession, folder: str) -> DataFrame:
    return _reports(spark, folder)


@query(
    "g16_workspace_report",
    f"SELECT count(*) AS total_projects, count(*) FILTER (WHERE status = 'fail') AS failed_projects, sum(total)::BIGINT AS total_violations, "
    f"sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, sum(info)::BIGINT AS info, "
    f"count(*) FILTER (WHERE status = 'fail') = 0 AS passed FROM ({_REPORT})",
)
def g16_fleet(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.workspace_report(_reports(spark, folder))


# --- ordering and links ---------------------------------------------------------


@query(
    "o1_sort_deps",
    "SELECT project_id, source_file, import_path, source_line FROM t_deps ORDER BY ALL",
)
def o1(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.sort_deps(deps_from_trade(spark, folder)).select(
        "project_id", "source_file", "import_path", "source_line"
    )


@query(
    "o2_sort_violations",
    "SELECT project_id, file, line, rule_ord FROM t_viol ORDER BY ALL",
)
def o2(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.sort_violations(violations(spark, folder)).select("project_id", "file", "line", "rule_ord")


@query(
    "h15_suggest_fix",
    """
SELECT project_id, rule_id, kind, description, iface AS interface, diff, count(*) AS n FROM (
  SELECT project_id, rule_id, CASE WHEN rule_id = 'domain-imports-infrastructure' OR (source_layer = 'domain' AND target_layer = 'infrastructure') THEN 'domain'
    WHEN source_layer = 'application' AND target_layer = 'infrastructure' THEN 'application' ELSE 'generic' END AS kind,
    upper(substr(regexp_extract(import_path, '[^/]*$'), 1, 1)) || substr(regexp_extract(import_path, '[^/]*$'), 2) || 'Repository' AS iface,
    CASE WHEN kind = 'domain' THEN 'Extract an interface from ' || import_path || ' and inject it via constructor'
         WHEN kind = 'application' THEN 'Move the infrastructure dependency behind a port interface'
         ELSE 'Review the dependency from ' || source_layer || ' to ' || target_layer || '. Consider extracting an interface.' END AS description,
    CASE WHEN kind = 'application' THEN '' ELSE '--- a/' || file || chr(10) || '+++ b/' || file || chr(10) || '@@ -' || line || ' +' || line || ' @@' || chr(10) ||
    CASE WHEN kind = 'domain' THEN '-// TODO: replace direct import with interface' || chr(10) || '+// Define interface in domain layer, inject via constructor'
         ELSE '-// TODO: fix violation' || chr(10) || '+// Extract interface and inject via constructor' END END AS diff
  FROM t_viol) GROUP BY ALL
""",
)
def h15(spark: SparkSession, folder: str) -> DataFrame:
    return (
        guidance.suggest_fix(violations(spark, folder))
        .groupBy("project_id", "rule_id", "kind", "description", "interface", "diff")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "a3_deps_from_pages",
    """
SELECT project_id, source_file, source_line, import_path FROM (
  SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS project_id,
         regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS source_file,
         unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS import_path,
         CAST(generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS INT) AS source_line FROM pages)
""",
)
def a3(spark: SparkSession, folder: str) -> DataFrame:
    return deps_from_pages(spark, folder)


# --- projects with configurations of their own ----------------------------------

#: what three of the projects set themselves; the others have the shared configuration
_OWN_LAYERS = (("south", ["africa/**", "america/nation_1*/**"]), ("rest", ["america", "asia/*/s*", "**/c*"]))
_OWN_RULES = [
    {"ord": 1, "id": "own-views", "from_layer": "domain", "to_layers": ["presentation", "application"], "type": "cannot", "severity": "warning",
     "exclude": ["africa/nation_0/**", "africa/nation_5/s*1"],
     "overrides": [{"path": "africa/nation_5", "severity": "error"}, {"path": "africa/", "severity": "info"}, {"path": "africa/nation_14/", "enabled": False}]},
    {"ord": 2, "id": "own-threes", "from_layer": "presentation", "to_layers": ["application"], "type": "MustNotCircular", "severity": "error",
     "pattern": "/c[0-9]*3$", "explanation": "No threes"},
    {"ord": 3, "id": "own-sevens", "from_layer": "", "to_layers": [], "type": "Cannot", "severity": "info", "pattern": "c7"},
    {"ord": 4, "id": "own-can", "from_layer": "domain", "to_layers": ["domain"], "type": "Can", "severity": "info"},
]
_OWN_EXCLUDES = ["europe/nation_19/", "*9", "asia/**/s*3"]


def trade_fleet(spark: SparkSession, folder: str) -> fleet.Fleet:
    """The shared trade configuration, layers of 1-URGENT, rules of 2-HIGH, and settings of 5-LOW and 3-MEDIUM."""
    known = projects(spark, folder)

    def of(project: str) -> DataFrame:
        return known.where(F.col("project_id") == project)

    own = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.array(*map(F.lit, p)).alias("paths"), F.lit("").alias("description"), F.array().cast("array<string>").alias("tags")) for i, (n, p) in enumerate(_OWN_LAYERS, 1)]
    kind = "array<struct<ord:int,id:string,from_layer:string,to_layers:array<string>,type:string,severity:string,explanation:string,pattern:string,exclude:array<string>,overrides:array<struct<path:string,severity:string,enabled:boolean>>,template:string,params:map<string,string>>>"
    return fleet.Fleet(
        TRADE,
        layers=of("1-URGENT").select("project_id", F.inline(F.array(*own))),
        rules=of("2-HIGH").select("project_id", F.inline(F.from_json(F.lit(json.dumps(_OWN_RULES)), kind))),
        settings=known.where("project_id in ('3-MEDIUM', '5-LOW')").select(
            "project_id",
            F.when(F.col("project_id") == "5-LOW", F.array(*map(F.lit, _OWN_EXCLUDES))).alias("exclude"),
            F.when(F.col("project_id") == "3-MEDIUM", 100000).alias("max_violations"),
        ),
    )


block(
    "t_fleet",
    f"""
SELECT {VIOL} FROM t_hits WHERE project_id NOT IN ('1-URGENT', '2-HIGH', '5-LOW')
UNION ALL SELECT {VIOL} FROM t_hits WHERE project_id = '5-LOW' AND NOT starts_with(source_file, 'europe/nation_19/')
  AND NOT source_file LIKE '%9' AND NOT (starts_with(source_file, 'asia/') AND regexp_matches(source_file, '/s[^/]*3$'))
UNION ALL SELECT project_id, 3, 'no-hot-customers', source_file, source_line, sl, tl, import_path,
  sl || ' cannot depend on ' || tl || ' (import: ' || import_path || ')', CASE WHEN starts_with(source_file, 'europe/') THEN 'warning' ELSE 'info' END,
  CASE WHEN starts_with(source_file, 'europe/') THEN 'info' ELSE '' END, starts_with(source_file, 'europe/')
FROM (SELECT *, CASE WHEN starts_with(source_file, 'africa/') OR regexp_matches(source_file, '^america/nation_1[^/]*/') THEN 'south'
    WHEN starts_with(source_file, 'america') OR regexp_matches(source_file, '^asia/[^/]*/s[^/]*$') THEN 'rest' END AS sl,
  CASE WHEN starts_with(import_path, 'africa/') OR regexp_matches(import_path, '^america/nation_1[^/]*/') THEN 'south' ELSE 'rest' END AS tl
  FROM t_deps WHERE project_id = '1-URGENT') WHERE sl IS NOT NULL AND regexp_matches(import_path, '/c[0-9]*7$')
UNION ALL SELECT project_id, 1, 'own-views', source_file, source_line, source_layer, resolved_layer, import_path,
  source_layer || ' cannot depend on ' || resolved_layer || ' (import: ' || import_path || ')',
  CASE WHEN starts_with(source_file, 'africa/nation_5/') THEN 'error' ELSE 'info' END, 'warning', TRUE
FROM t_edges WHERE project_id = '2-HIGH' AND source_layer = 'domain' AND resolved_layer IN ('presentation', 'application')
  AND NOT starts_with(source_file, 'africa/nation_0/') AND NOT regexp_matches(source_file, '^africa/nation_5/s[^/]*1$') AND NOT starts_with(source_file, 'africa/nation_14/')
UNION ALL SELECT project_id, 2, 'own-threes', source_file, source_line, source_layer, resolved_layer, import_path,
  'No threes: ' || source_layer || ' cannot import ' || resolved_layer, 'error', '', FALSE
FROM t_edges WHERE project_id = '2-HIGH' AND source_layer = 'presentation' AND resolved_layer = 'application' AND regexp_matches(import_path, '/c[0-9]*3$')
UNION ALL SELECT project_id, 3, 'own-sevens', source_file, source_line, source_layer, resolved_layer, import_path,
  source_layer || ' cannot depend on ' || resolved_layer || ' (import: ' || import_path || ')', 'info', '', FALSE
FROM t_edges WHERE project_id = '2-HIGH' AND regexp_matches(import_path, 'c7')
""",
)


@query("l9_project_configs", "SELECT * FROM t_fleet")
def l9_configs(spark: SparkSession, folder: str) -> DataFrame:
    config = fleet.merge_configs(spark, trade_fleet(spark, folder))
    edges = fleet.classified_by_project(stored(spark, folder), config)
    return fleet.standard_violations_by_project(edges, config)


@query(
    "r21_evaluate_fleet",
    "SELECT project_id, rule_id, severity, count(*) AS n, count(*) FILTER (WHERE starts_with(import_path, 'circular: ')) AS cycles FROM ("
    "SELECT project_id, rule_id, severity, import_path FROM t_fleet UNION ALL "
    "SELECT project_id, rule_id, severity, import_path FROM t_circ WHERE project_id NOT IN ('1-URGENT', '2-HIGH') UNION ALL "
    "SELECT project_id, 'own-threes', 'error', 'circular: ' FROM t_cycles WHERE project_id = '2-HIGH' "
    "AND list_contains(cycle, 'presentation') AND list_contains(cycle, 'application')) GROUP BY 1, 2, 3",
)
def r21_fleet(spark: SparkSession, folder: str) -> DataFrame:
    found = fleet.evaluate_fleet(stored(spark, folder), trade_fleet(spark, folder), projects(spark, folder))
    return found.groupBy("project_id", "rule_id", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("import_path").startswith("circular: "), 1)).alias("cycles")
    )


@query(
    "g15_gate_by_project",
    "SELECT p.project_id, count(v.project_id) AS counted, CASE WHEN p.project_id = '3-MEDIUM' THEN 100000 ELSE 0 END AS allowed, "
    "count(v.project_id) <= CASE WHEN p.project_id = '3-MEDIUM' THEN 100000 ELSE 0 END AS passed "
    "FROM t_projects p LEFT JOIN (SELECT * FROM t_fleet WHERE NOT overridden) v USING (project_id) GROUP BY 1",
)
def g15_by_project(spark: SparkSession, folder: str) -> DataFrame:
    return fleet.gate_by_project(l9_configs(spark, folder), trade_fleet(spark, folder), projects(spark, folder))


block(
    "t_lint",
    """
SELECT 'n' || s_nationkey AS project_id, s_suppkey AS k, 'r' || s_suppkey AS id, s_suppkey % 12 AS kind FROM supplier
""",
)


@query(
    "r22_lint_config",
    """
SELECT project_id, id AS subject, unnest(CASE kind
  WHEN 0 THEN ['invalid pattern ' || chr(39) || 'a(' || k || chr(39)]
  WHEN 1 THEN ['unknown template ' || chr(39) || 'min-deps' || chr(39)]
  WHEN 2 THEN ['missing required param ' || chr(39) || 'max' || chr(39) || ' for template ' || chr(39) || 'max-deps' || chr(39), 'template param ' || chr(39) || 'to' || chr(39) || ' references unknown layer gone']
  WHEN 3 THEN ['param ' || chr(39) || 'min' || chr(39) || ' for template ' || chr(39) || 'layer-balance' || chr(39) || ': expected int']
  WHEN 4 THEN ['param ' || chr(39) || 'forbidden' || chr(39) || ' for template ' || chr(39) || 'no-leak' || chr(39) || ': expected []string', 'template param ' || chr(39) || 'forbidden' || chr(39) || ' references unknown layer core;']
  WHEN 5 THEN [chr(39) || 'check' || chr(39) || ' expression rules cannot have ' || chr(39) || 'from' || chr(39) || ' field', chr(39) || 'check' || chr(39) || ' expression rules cannot have ' || chr(39) || 'to' || chr(39) || ' field']
  WHEN 6 THEN ['invalid severity']
  WHEN 7 THEN ['invalid rule type']
  ELSE [] END) AS finding FROM t_lint
UNION ALL SELECT project_id, 'f' || k, unnest(CASE kind WHEN 9 THEN ['invalid identifier'] ELSE [] END) FROM (SELECT project_id, k || '-' AS k, kind FROM t_lint)
UNION ALL SELECT project_id, 'g' || k, 'circular reference: g' || k || ' -> h' || k || ' -> g' || k FROM t_lint WHERE kind = 10
UNION ALL SELECT project_id, 'python', 'plugin name conflicts with a built-in detector' FROM t_lint WHERE kind = 11
UNION ALL SELECT project_id, 'python', 'invalid timeout ' || chr(39) || k || 'sec' || chr(39) FROM t_lint WHERE kind = 11
UNION ALL SELECT project_id, 'python', 'duplicate plugin name' FROM t_lint WHERE kind = 11 GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT project_id, 'max_violations', 'max_violations cannot be negative (got ' || -k || ')' FROM t_lint WHERE kind = 8 AND k > 0
UNION ALL SELECT project_id, 'mapping ' || k, 'language is required' FROM t_lint WHERE kind = 8
UNION ALL SELECT project_id, 'mapping ' || k, 'match strategy must be ' || chr(39) || 'stem' || chr(39) || ' or ' || chr(39) || 'glob' || chr(39) FROM t_lint WHERE kind = 8
""",
)
def r22_config(spark: SparkSession, folder: str) -> DataFrame:
    supplier, key = table(spark, folder, "supplier"), F.col("s_suppkey")
    kind, text = key % 12, key.cast("string")
    rows = supplier.select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("project_id"), kind.alias("kind"), text.alias("k"), key.alias("n")
    )
    k, text = F.col("kind"), F.col("k")
    lone = (k < 6) & (k != 5)
    own = rows.select(
        "project_id",
        F.concat(F.lit("r"), text).alias("id"),
        F.when(lone, "").otherwise("core").alias("from_layer"),
        F.when(lone, F.array().cast("array<string>")).otherwise(F.array(F.lit("edge"))).alias("to_layers"),
        F.when(k == 7, "Cant").otherwise("Cannot").alias("type"),
        F.when(k == 6, "fatal").otherwise("error").alias("severity"),
        F.when(k == 0, F.concat(F.lit("a("), text)).when(k > 6, "^a+$").otherwise("").alias("pattern"),
        F.when(k == 1, "min-deps").when(k == 2, "max-deps").when(k == 3, "layer-balance").when(k == 4, "no-leak").otherwise("").alias("template"),
        F.array().cast("array<struct<path:string,severity:string,enabled:boolean>>").alias("overrides"),
        F.when(k == 2, F.create_map(F.lit("from"), F.lit("core"), F.lit("to"), F.lit('["edge", "gone"]')))
        .when(k == 3, F.create_map(F.lit("min"), F.lit("few"), F.lit("max"), F.lit("10")))
        .when(k == 4, F.create_map(F.lit("layer"), F.lit("core"), F.lit("forbidden"), F.lit("core;")))
        .alias("params"),
        F.when(k == 5, "count() > 3").otherwise("").alias("check"),
    )
    names = F.explode(F.array(F.lit("core"), F.lit("edge"))).alias("name")
    layer_rows = rows.select("project_id").distinct().select("project_id", names).withColumn("paths", F.array(F.concat("name", F.lit("/**"))))
    settings = rows.where(k == 8).select(
        "project_id", (-F.col("n")).cast("int").alias("max_violations"), F.create_map(F.lit("error"), F.lit("info")).alias("severity_map")
    )

    def call(name: str, to: str, suffix: str = ""):
        return F.struct(F.concat(F.lit(name), text, F.lit(suffix)).alias("name"), F.array(F.concat(F.lit(to), text), F.lit("count")).alias("calls"))

    functions = rows.select("project_id", F.inline(F.when(k == 9, F.array(call("f", "x", "-"))).when(k == 10, F.array(call("g", "h"), call("h", "g"))).otherwise(F.array(call("ok", "none")))))
    plugins = rows.where(k == 11).select(
        "project_id", F.lit("python").alias("name"), F.lit("run").alias("command"), F.array(F.lit("x")).alias("languages"), F.concat(text, F.lit("sec")).alias("timeout")
    )
    mappings = rows.where(k == 8).select(
        "project_id", F.col("n").alias("ord"), F.lit("*.a").alias("source_glob"), F.lit("*.b").alias("generated_glob"), F.lit("").alias("language"), F.lit("name").alias("strategy")
    )
    return linting.lint_config(own, layer_rows, settings, functions, plugins, mappings)
