"""Cycles, pairs, coupling and file groups against brute force."""

import itertools
import random
import time

from strata.model import Config, Layer, Rule
from strata.operators import graph, metrics, scoring
from pyspark.sql import functions as F

EDGE = "project_id string, source_file string, source_line int, import_path string, source_layer string, resolved_layer string"


def edges_of(spark, pairs, project="p"):
    return spark.createDataFrame([(project, f"{a}/f", i, b, a, b) for i, (a, b) in enumerate(pairs, 1)], EDGE)


def brute_cycles(pairs):
    nodes = sorted({x for p in pairs for x in p})
    out = set()
    for n in range(1, len(nodes) + 1):
        for ring in itertools.permutations(nodes, n):
            if ring[0] == min(ring) and all((ring[i], ring[(i + 1) % n]) in pairs for i in range(n)):
                out.add((*ring, ring[0]))
    return out


def brute_shortest(pairs):
    """For each edge the shortest elementary cycle through it, ties by the names after the edge."""
    out = {(a, a) for a, b in pairs if a == b}
    for a, b in pairs:
        if a != b:
            turned = []
            for cycle in brute_cycles(pairs):
                ring = list(cycle[:-1])
                for i, node in enumerate(ring):
                    if len(ring) > 1 and node == a and ring[(i + 1) % len(ring)] == b:
                        start = ring[(i + 1) % len(ring) :] + ring[: (i + 1) % len(ring)]
                        turned.append((len(ring), start, cycle))
            if turned:
                out.add(min(turned)[2])
    return out


def test_cycles_match_brute_force(spark):
    rng = random.Random(11)
    for _ in range(5):
        nodes = "abcde"
        pairs = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.randint(3, 14))}
        found = graph.layer_cycles(graph.layer_edges(edges_of(spark, sorted(pairs))))
        got = [tuple(r.cycle) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == brute_shortest(pairs)
    for _ in range(200):
        pairs = {(rng.choice("abcdef"), rng.choice("abcdef")) for _ in range(rng.randint(1, 16))}
        assert graph.shortest_cycles(pairs) == brute_shortest(pairs)


def test_cycle_evidence_and_flags(spark):
    found = graph.layer_cycles(graph.layer_edges(edges_of(spark, [("a", "b"), ("b", "a"), ("a", "a")])))
    paths = {tuple(r.cycle): r.path for r in found.collect()}
    assert paths[("a", "b", "a")] == ["a (a/f:1)", "b (b/f:2)", "a"] and paths[("a", "a")] == ["a (a/f:3)", "a"]
    no_self = graph.layer_cycles(graph.layer_edges(edges_of(spark, [("a", "a")])), include_self=False)
    assert no_self.count() == 0


def test_rings_of_any_length_and_dense_graphs(spark):
    from strata.plans.check import evaluate_rules

    for n in (9, 10, 40):
        names = [f"l{i:02d}" for i in range(n)]
        config = Config(tuple(Layer(x, (f"{x}/",)) for x in names))
        rows_ = [("p", f"{a}/f", 1, f"{b}/g", b, "go") for a, b in zip(names, names[1:] + names[:1])]
        deps = spark.createDataFrame(
            rows_, "project_id string, source_file string, source_line int, import_path string, resolved_layer string, language string"
        )
        found = evaluate_rules(deps, config, deps.select("project_id").distinct()).collect()
        assert [r.rule_id for r in found] == ["no-circular-dependencies"] and found[0].import_path.count("→") == n
    dense = {(f"n{i}", f"n{j}") for i in range(20) for j in range(20) if i != j}
    assert len(graph.shortest_cycles(dense)) == 190


def test_circular_violations(spark, rows):
    cycles = graph.layer_cycles(graph.layer_edges(edges_of(spark, [("a", "b"), ("b", "a")])))
    default = graph.circular_violations(cycles, Config((Layer("a", ("a/",)),)))
    assert rows(default, "rule_id", "file", "line", "import_path") == [
        ("no-circular-dependencies", "a/f", 1, "circular: a → b → a")
    ]
    scoped = Config((), (Rule("c", "a", ("z",), "MustNotCircular"), Rule("d", "b", ("a",), "MustNotCircular", "info")))
    assert rows(graph.circular_violations(cycles, scoped), "rule_id", "severity") == [("d", "info")]


def test_pairs_and_coupling(spark, rows):
    pairs = [("a", "b")] * 3 + [("b", "a"), ("a", "c"), ("c", "c")] + [("b", "c")] * 7
    coupling = scoring.coupling_matrix(edges_of(spark, pairs))
    assert coupling.agg(F.sum("cnt")).first()[0] == len(pairs)
    both = graph.bidirectional_pairs(coupling)
    assert rows(both, "layer_a", "layer_b") == [("a", "b"), ("c", "c")]
    assert rows(graph.bidirectional_pairs(coupling, include_self=False), "layer_a") == [("a",)]
    shares = scoring.coupling_pct(coupling)
    assert abs(shares.agg(F.sum("pct")).first()[0] - 100) < 1e-9
    stats = {r.layer: r for r in scoring.layer_stats(coupling).collect()}
    assert (stats["a"].outgoing, stats["a"].incoming, stats["a"].net, stats["a"].source_heavy) == (4, 1, -3, True)
    assert (stats["c"].outgoing, stats["c"].incoming, stats["c"].target_heavy) == (0, 8, True)
    bands = {(r.from_layer, r.to_layer): r.band for r in scoring.coupling_band(coupling).collect()}
    assert bands[("b", "c")] == "medium" and bands[("a", "c")] == ""


def brute_groups(pairs):
    reach = {}
    nodes = {x for p in pairs for x in p}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for a, b in pairs:
                if a == todo[0] and b not in seen:
                    seen.add(b)
                    todo.append(b)
            todo.pop(0)
        reach[n] = seen
    groups = set()
    for n in nodes:
        members = {m for m in nodes if m == n or (m in reach[n] and n in reach[m])}
        if len(members) > 1:
            groups |= {(m, min(members)) for m in members}
    return groups


def test_long_chain_of_files(spark, rows):
    """A chain of 5,000 files that ends in two files importing each other."""
    name = lambda i: f"f{i:05d}"
    pairs = [(name(i), name(i + 1)) for i in range(5000)] + [(name(5001), name(5000)), (name(5000), name(5001))]
    pairs += [(f"r{i}", f"r{(i + 1) % 37}") for i in range(37)]
    df = spark.createDataFrame([("p", a, b) for a, b in pairs], "project_id string, src string, dst string")
    got = rows(graph.file_cycles(df), "file", "component")
    assert got == sorted([(name(5000), name(5000)), (name(5001), name(5000))] + [(f"r{i}", "r0") for i in range(37)])


def test_file_cycles_of_shortened_chains(spark, rows):
    rng = random.Random(3)
    for _ in range(3):
        # few nodes with several edges, many on chains between them
        hubs = [f"h{i}" for i in range(4)]
        pairs, k = [], 0
        for _ in range(7):
            a, b, n = rng.choice(hubs), rng.choice(hubs), rng.randint(0, 3)
            line = [a, *[f"c{k + i}" for i in range(n)], b]
            k += n
            pairs += list(zip(line, line[1:]))
        # one way out of every hub, which a turned edge would close
        pairs += [(h, f"out{i}") for i, h in enumerate(hubs)] + [(f"out{i}", f"out{i + 1}") for i in range(3)]
        df = spark.createDataFrame([("p", a, b) for a, b in pairs], "project_id string, src string, dst string")
        assert set(rows(graph.file_cycles(df), "file", "component")) == brute_groups([(a, b) for a, b in pairs if a != b])
    # a chain out of a pair and into another is on no cycle
    one_way = [("a", "b"), ("b", "a"), ("b", "c1"), ("c1", "c2"), ("c2", "d"), ("d", "e"), ("e", "d"), ("a", "d"), ("b", "e"), ("d", "f"), ("f", "d")]
    df = spark.createDataFrame([("p", a, b) for a, b in one_way], "project_id string, src string, dst string")
    assert set(rows(graph.file_cycles(df), "file", "component")) == brute_groups(one_way)


def test_file_cycles_match_brute_force(spark, rows):
    rng = random.Random(5)
    nodes = [f"n{i:02d}" for i in range(14)]
    pairs = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(22)})
    df = spark.createDataFrame([("p", a, b) for a, b in pairs] + [("q", "x", "y")], "project_id string, src string, dst string")
    got = set(rows(graph.file_cycles(df), "file", "component"))
    assert got == brute_groups([p for p in pairs if p[0] != p[1]])


def test_file_cycles_over_many_blocks(spark, rows):
    """Blocks of a few files, so that groups, dropped and bridged files cross them."""
    rng = random.Random(11)
    for n, m, size in ((40, 70, 4), (60, 66, 7), (30, 120, 5)):
        nodes = [f"n{i:02d}" for i in range(n)]
        pairs = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(m)})
        df = spark.createDataFrame([("p", a, b) for a, b in pairs], "project_id string, src string, dst string")
        got = set(rows(graph.file_cycles(df, block_files=size), "file", "component"))
        assert got == brute_groups([p for p in pairs if p[0] != p[1]])


def test_ladder_of_files(spark, rows):
    """5,000 files, each with the next two, and one file that closes a part of it."""
    name = lambda i: f"f{i:05d}"
    pairs = [(name(i), name(i + k)) for i in range(5000) for k in (1, 2)] + [(name(3000), name(1000))]
    df = spark.createDataFrame([("p", a, b) for a, b in pairs], "project_id string, src string, dst string")
    want = [(name(i), name(1000)) for i in range(1000, 3001)]
    for block_files in (50_000, 700):
        start = time.perf_counter()
        assert rows(graph.file_cycles(df, block_files=block_files), "file", "component") == want
        assert time.perf_counter() - start < 60


def test_files_in_no_order(spark, rows):
    """A ladder whose names say nothing about its order, in small blocks."""
    order = list(range(1200))
    random.Random(2).shuffle(order)
    name = lambda i: f"f{order[i]:05d}"
    pairs = [(name(i), name(i + k)) for i in range(1197) for k in (1, 2)] + [(name(900), name(300))]
    df = spark.createDataFrame([("p", a, b) for a, b in pairs], "project_id string, src string, dst string")
    members = [name(i) for i in range(300, 901)]
    assert rows(graph.file_cycles(df, block_files=100), "file", "component") == sorted((m, min(members)) for m in members)


def test_local_groups():
    from strata.operators.local_graph import groups

    rng = random.Random(1)
    for _ in range(200):
        edges = {i: [] for i in range(12)}
        for _ in range(rng.randrange(30)):
            edges[rng.randrange(12)].append(rng.randrange(12))
        want = brute_groups([(a, b) for a in edges for b in edges[a]])
        got = groups(edges)
        assert {(m, r) for m, r in got.items() if sum(v == r for v in got.values()) > 1} == {(m, r) for m, r in want}


def test_metrics(spark):
    edges = edges_of(spark, [("a", "b"), ("a", "b"), ("b", "c")])
    projects = spark.createDataFrame([("p",), ("empty",)], "project_id string")
    table = metrics.evaluate_metrics(
        edges,
        projects,
        {
            "ab": metrics.expr_count(metrics.expr_deps("a", "b")),
            "line1": metrics.expr_count(metrics.expr_filter(metrics.expr_deps("a", "b"), "SourceLine <= 1")),
            "files": metrics.expr_files("a"),
            "any": metrics.expr_any(metrics.expr_deps("a", "z")),
        },
    )
    got = {r.project_id: (r.ab, r.line1, r.files, r.any) for r in table.collect()}
    assert got == {"p": (2, 1, 1, False), "empty": (0, 0, 0, False)}
    ratio = table.select("project_id", metrics.expr_ratio(F.col("ab"), F.col("line1")).alias("r"))
    assert dict(ratio.collect()) == {"p": 2, "empty": 0}
    hits = metrics.expr_rule(table, [(1, "r", F.col("ab") == 0, "error", ""), (2, "s", F.col("ab") > 1, "info", "t")])
    assert {(r.project_id, r.rule_id, r.message) for r in hits.collect()} == {
        ("empty", "r", "Expression check failed: r"),
        ("p", "s", "t"),
    }


def test_expression_errors(spark):
    import pytest

    for bad in ("SourceLine", "Ghost == 1", "ImportPath < x"):
        with pytest.raises(ValueError):
            metrics.expr_filter(F.lit(True), bad)
    functions = metrics.Functions()
    with pytest.raises(ValueError):
        functions.define("count", lambda f: F.lit(1))
    functions.define("a", lambda f: f("b"))
    functions.define("b", lambda f: f("a"))
    with pytest.raises(ValueError):
        functions("a")
