"""Graph operators.

Layer graphs are tiny per project (a config has a handful of layers), so they
are aggregated out of the edge table first and only then searched. The
file-level graph is fact-sized and is contracted in blocks, round by round.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.model import VIOLATION_COLUMNS, Config
from strata.operators.local_graph import contracted, grouped_files
from strata.operators.rules import circular_rules
from strata.session import materialise

ARROW = " → "


def layer_edges(edges: DataFrame) -> DataFrame:
    """F1 ``layer_edges``: distinct layer pairs with the first evidence edge.

    First means smallest (file, line, import): a partial aggregate, so a hot
    pair never travels whole.
    """
    evidence = F.min(F.struct("source_file", "source_line", "import_path"))
    return (
        edges.groupBy("project_id", "source_layer", F.col("resolved_layer").alias("target_layer"))
        .agg(evidence.alias("e"))
        .select(
            "project_id",
            "source_layer",
            "target_layer",
            F.col("e.source_file").alias("file"),
            F.col("e.source_line").alias("line"),
        )
    )


def layer_cycles(pairs: DataFrame, include_self: bool = True) -> DataFrame:
    """F2 ``layer_cycles``: for every layer edge on a cycle, the shortest cycle through it.

    Of equally short ones the smallest by the names from the edge's target on; each
    cycle is listed once, from its smallest layer. So every edge that lies on a cycle is
    on a listed one, whatever its length, and there are at most as many as edges. A
    project's layer graph is bounded by its configured layers squared and is searched
    as one group. Returns (project_id, cycle [closed], path [evidence]).
    """
    rows = pairs.select("project_id", "source_layer", "target_layer", "file", "line")
    schema = "project_id string, cycle array<string>, path array<string>"

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        why = {(r.source_layer, r.target_layer): f"{r.source_layer} ({r.file}:{r.line})" for r in frame.itertuples()}
        cycles = [list(c) for c in sorted(shortest_cycles(set(why), include_self))]
        return pd.DataFrame(
            {
                "project_id": [key[0]] * len(cycles),
                "cycle": cycles,
                "path": [[why[e] for e in zip(c, c[1:], strict=False)] + [c[0]] for c in cycles],
            },
            dtype=object,
        )

    return rows.groupBy("project_id").applyInPandas(search, schema)


def shortest_cycles(edges: set[tuple[str, str]], include_self: bool = True) -> set[tuple[str, ...]]:
    """Closed node tuples, smallest node first, of the shortest cycle through each edge."""
    after: dict[str, list[str]] = {}
    for a, b in sorted(edges):
        if a != b:
            after.setdefault(a, []).append(b)
    out = {(a, a) for a, b in edges if a == b} if include_self else set()
    for start in {b for a, b in edges if a != b}:
        # by rings around the start: the first path to a layer in order of names is its smallest
        paths, ring = {start: (start,)}, [(start,)]
        while ring:
            grown: dict[str, tuple[str, ...]] = {}
            for path in sorted(ring):
                for layer in after.get(path[-1], ()):
                    if layer not in paths and layer not in grown:
                        grown[layer] = (*path, layer)
            paths.update(grown)
            ring = list(grown.values())
        for a in paths:
            if a != start and (a, start) in edges:
                nodes = paths[a]
                low = nodes.index(min(nodes))
                out.add((*nodes[low:], *nodes[:low], nodes[low]))
    return out


def canonical_cycle(cycles: DataFrame) -> DataFrame:
    """F3 ``canonical_cycle``: rotate to the smallest node, close, dedupe.

    Adds ``n_nodes``; order by (n_nodes, cycle) to list shortest first.
    """
    ring = F.slice(F.col("cycle"), F.lit(1), F.size("cycle") - 1)
    start = F.array_position("ring", F.array_min("ring")).cast("int")
    turned = F.concat(
        F.slice("ring", start, F.size("ring")), F.slice("ring", F.lit(1), F.greatest(start - 1, F.lit(0)))
    )
    return (
        cycles.withColumn("ring", ring)
        .withColumn("ring", turned)
        .select(
            "project_id",
            F.concat("ring", F.slice("ring", 1, 1)).alias("cycle"),
            F.size("ring").alias("n_nodes"),
        )
        .distinct()
    )


def circular_violations(cycles: DataFrame, config: Config) -> DataFrame:
    """F4 ``circular_violations``: one violation per cycle and circular rule.

    The rules are literal; a rule with explicit layers covers the cycles that
    pass through its ``from`` layer and one of its targets.
    """
    hits = []
    for i, rule in circular_rules(config):
        scope = F.lit(True)
        if rule.from_layer not in ("", "*"):
            scope = scope & F.array_contains("cycle", rule.from_layer)
        if rule.to_layers and "*" not in rule.to_layers:
            scope = scope & F.arrays_overlap("cycle", F.array(*[F.lit(t) for t in rule.to_layers]))
        hits.append(
            F.when(
                scope,
                F.struct(
                    F.lit(i).alias("rule_ord"), F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity")
                ),
            )
        )
    return _circular_rows(cycles.withColumn("h", F.explode(F.array_compact(F.array(*hits)))))


def circular_violations_by_table(cycles: DataFrame, rules: DataFrame) -> DataFrame:
    """F4 with a rule table: ``rules`` has project_id, rule_ord, rule_id, from_layer, to_layers, severity.

    Every project has rows of its own there; names are compared as in the literal form.
    """
    kept = cycles.join(rules, "project_id")
    begins = F.col("from_layer").isin("", "*") | F.array_contains("cycle", F.col("from_layer"))
    ends = (F.size("to_layers") == 0) | F.array_contains("to_layers", "*") | F.arrays_overlap("cycle", "to_layers")
    return _circular_rows(kept.where(begins & ends).withColumn("h", F.struct("rule_ord", "rule_id", "severity")))


def _circular_rows(hits: DataFrame) -> DataFrame:
    """Cycles with the rule ``h`` they break, as violations."""
    shown = F.array_join("cycle", ARROW)
    evidence = F.element_at("path", 1)
    message = F.concat(
        F.lit("Circular dependency detected: "),
        shown,
        F.lit(
            ". This creates tightly coupled code that is hard to test, modify, and deploy. "
            "Break the cycle by extracting shared abstractions or using dependency injection."
        ),
    )
    return hits.select(
        "project_id",
        "h.rule_ord",
        "h.rule_id",
        F.regexp_extract(evidence, r"\((.*):\d+\)$", 1).alias("file"),
        F.regexp_extract(evidence, r":(\d+)\)$", 1).cast("int").alias("line"),
        F.element_at("cycle", 1).alias("source_layer"),
        F.element_at("cycle", -2).alias("target_layer"),
        F.concat(F.lit("circular: "), shown).alias("import_path"),
        message.alias("message"),
        "h.severity",
        F.lit("").alias("original_severity"),
        F.lit(False).alias("overridden"),
    ).select(*VIOLATION_COLUMNS)


def bidirectional_pairs(coupling: DataFrame, include_self: bool = True) -> DataFrame:
    """F5 ``bidirectional_pairs``: layer pairs coupled both ways, each once.

    One grouped pass: fold each pair to (smaller, larger) and keep those seen
    in both directions. A layer coupled to itself counts as a pair.
    """
    both = coupling.groupBy(
        "project_id",
        F.least("from_layer", "to_layer").alias("layer_a"),
        F.greatest("from_layer", "to_layer").alias("layer_b"),
    ).agg(F.count_distinct("from_layer").alias("directions"))
    hit = (F.col("layer_a") == F.col("layer_b")) if include_self else F.lit(False)
    return both.where((F.col("directions") == 2) | hit).select("project_id", "layer_a", "layer_b")


def pair_count(pairs: DataFrame, projects: DataFrame) -> DataFrame:
    """F6 ``has_cycles`` / ``pair_count`` per project."""
    counts = pairs.groupBy("project_id").agg(F.count(F.lit(1)).alias("pair_count"))
    return (
        projects.select("project_id")
        .distinct()
        .join(counts, "project_id", "left")
        .na.fill(0, ["pair_count"])
        .withColumn("has_cycles", F.col("pair_count") > 0)
    )


def graph_layer_export(edges: DataFrame, violations: DataFrame) -> DataFrame:
    """F7 ``graph_layer_export``: layer edges without self-edges, count and violation flag."""
    counts = (
        edges.where("source_layer <> resolved_layer")
        .groupBy("project_id", "source_layer", F.col("resolved_layer").alias("target_layer"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    bad = violations.select("project_id", "source_layer", "target_layer").distinct().withColumn("bad", F.lit(True))
    return counts.join(bad, ["project_id", "source_layer", "target_layer"], "left").select(
        "project_id", "source_layer", "target_layer", "cnt", F.coalesce("bad", F.lit(False)).alias("is_violation")
    )


def graph_file_nodes(edges: DataFrame) -> DataFrame:
    """F8 nodes: files by layer, importing and imported side."""
    sources = edges.where("source_layer is not null").select(
        "project_id", F.col("source_layer").alias("layer"), F.col("source_file").alias("node")
    )
    targets = edges.where("resolved_layer is not null").select(
        "project_id", F.col("resolved_layer").alias("layer"), F.col("import_path").alias("node")
    )
    return sources.unionByName(targets).distinct().withColumn("label", F.substring_index("node", "/", -1))


def graph_file_edges(edges: DataFrame, violations: DataFrame) -> DataFrame:
    """F8 edges: file -> import with count; flagged when the file breaks a rule towards that layer."""
    counts = (
        edges.where("resolved_layer is not null")
        .groupBy("project_id", "source_file", "import_path", F.col("resolved_layer").alias("target_layer"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    bad = (
        violations.select("project_id", F.col("file").alias("source_file"), "target_layer")
        .distinct()
        .withColumn("bad", F.lit(True))
    )
    return counts.join(bad, ["project_id", "source_file", "target_layer"], "left").select(
        "project_id",
        "source_file",
        "import_path",
        "target_layer",
        "cnt",
        F.coalesce("bad", F.lit(False)).alias("is_violation"),
    )


def file_cycles(file_edges: DataFrame, block_files: int = 50_000, every: int = 4) -> DataFrame:
    """F9 ``file_cycles``: strongly connected groups of the file graph.

    Input (project_id, src, dst); output (project_id, file, component) for files in a
    group of two or more, ``component`` being its smallest file.

    The graph is contracted in rounds. Files become numbers in the order of (project,
    file) and fall into blocks of ``block_files`` neighbours in that order. Inside its
    block a file is worked on by one task: groups become one file, files that no cycle can
    pass are dropped, and files with few edges are bridged, so a deep part shrinks to what
    its border needs, however long it is. What remains is a smaller graph with fewer
    blocks. A round that shrinks little orders files by their surroundings instead of
    their names, and one that still does not finds a group of each colour across blocks.

    Then the rounds are undone, last first: files of a block whose group is known count as
    one, and what forms a group with them or among itself inside the block joins it.
    """
    with_files = file_edges.where("src <> dst and project_id is not null").select("project_id", "src", "dst")
    nodes = with_files.select("project_id", F.col("src").alias("file")).union(with_files.select("project_id", "dst")).distinct()
    named = _placed(nodes, ["project_id", "file"]).withColumnRenamed("pos", "id")
    tails = named.select("project_id", F.col("file").alias("src"), F.col("id").alias("a"))
    heads = named.select("project_id", F.col("file").alias("dst"), F.col("id").alias("b"))
    live = materialise(
        with_files.join(tails, ["project_id", "src"]).join(heads, ["project_id", "dst"]).select("a", "b").distinct()
    )
    rounds: list[tuple[DataFrame | None, DataFrame]] = []
    size, near = live.count(), False
    while size:
        inside, done, live = _contract(live, block_files, near, every)
        rounds.append((inside, done))
        left = live.count()
        if left > 0.7 * size:
            if near:
                found = _colour_groups(live, every)
                rounds.append((None, found))
                gone = found.select("id")
                live = materialise(
                    live.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
                )
                left = live.count()
            near = not near
        size = left
    known = named.sparkSession.createDataFrame([], "id long, root long")
    for inside, done in reversed(rounds):
        known = materialise(known.union(done) if inside is None else _undone(inside, done, known))
    smallest = known.groupBy("root").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    files = named.select("id", "project_id", "file")
    firsts = named.select(F.col("id").alias("first"), F.col("file").alias("component"))
    return known.join(smallest, "root").join(files, "id").join(firsts, "first").select("project_id", "file", "component")


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows with their place in this order, from 0 and without gaps."""
    ranged = materialise(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    )
    part = F.shiftright("_m", 33).alias("_part")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    # one row a partition
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_part", part).join(offsets, "_part")
    return placed.withColumn("pos", F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_part", "_before")


def _contract(live: DataFrame, block_files: int, near: bool, hops: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: edges inside blocks, what became of their files (id, root: null if dropped), the smaller graph."""
    nodes = live.select(F.col("a").alias("id")).union(live.select("b")).distinct()
    if near:
        nodes = _surroundings(live, nodes, hops)
    places = _placed(nodes, ["label", "id"] if near else ["id"])
    blocks = materialise(places.select("id", F.floor(F.col("pos") / block_files).alias("block")))
    ends = live.join(blocks.select(F.col("id").alias("a"), F.col("block").alias("block_a")), "a").join(
        blocks.select(F.col("id").alias("b"), F.col("block").alias("block_b")), "b"
    )
    ends = materialise(ends.select("a", "b", "block_a", "block_b"))
    inside = ends.where("block_a = block_b").select(F.col("block_a").alias("block"), "a", "b")
    across = ends.where("block_a <> block_b")
    none = F.lit(None).cast("long")
    borders = across.select(F.col("block_a").alias("block"), "a", none.alias("b")).distinct().union(
        across.select(F.col("block_b").alias("block"), none.alias("a"), "b").distinct()
    )
    done = materialise(_by_block(inside.union(borders), contracted))
    changed = done.where("b is null").select(F.col("a").alias("id"), "root")
    fates = [changed.select(F.col("id").alias(c), F.col("root").alias(f"to_{c}"), F.lit(True).alias(f"hit_{c}")) for c in ("a", "b")]
    moved = across.select("a", "b").join(fates[0], "a", "left").join(fates[1], "b", "left")
    moved = moved.where("(hit_a is null or to_a is not null) and (hit_b is null or to_b is not null)")
    moved = moved.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
    rest = done.where("b is not null").select("a", "b").union(moved).where("a <> b").distinct()
    return inside, changed, materialise(rest)


def _surroundings(live: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """Files with the smallest hash within a few steps either way: neighbours mostly share it."""
    both = live.select("a", "b").union(live.select("b", "a"))
    current = nodes.withColumn("label", F.xxhash64("id"))
    for _ in range(hops):
        sent = both.join(current.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"), "label")
        current = current.union(sent).groupBy("id").agg(F.min("label").alias("label"))
    return current


def _by_block(rows: DataFrame, work) -> DataFrame:
    """Rows (block, a, b) of whole blocks through ``work(a, b)``, which returns rows (a, b, root)."""

    def run(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(work(table["a"], table["b"]), columns=["a", "b", "root"], dtype=object).astype("Int64")

    return rows.groupBy("block").applyInPandas(run, "a long, b long, root long")


def _undone(inside: DataFrame, done: DataFrame, known: DataFrame) -> DataFrame:
    """Groups of a round's files (id, root), from the groups of what it left."""
    # a file that became another one is in that one's group; others are in their own
    became = done.where("root is not null").select("id", F.col("root").alias("rep"))
    theirs = known.select(F.col("id").alias("rep"), F.col("root"))
    known = known.union(became.join(theirs, "rep").select("id", "root"))
    ends = inside.select("block", F.col("a").alias("id")).union(inside.select("block", "b")).distinct()
    # a known group goes to the blocks of its files as an edge both ways with a file of its own, below zero
    told = ends.join(known, "id").select("block", "id", (-1 - F.col("root")).alias("g"))
    rows = inside.select("block", "a", "b").union(told.select("block", "id", "g")).union(told.select("block", "g", "id"))
    found = _by_block(rows, grouped_files).select(F.col("a").alias("id"), "root").where("id >= 0")
    return found.union(known.join(found.select("id"), "id", "left_anti")).distinct()


def _colour_groups(live: DataFrame, every: int) -> DataFrame:
    """One strongly connected group of each colour: (id, root)."""
    nodes = live.select(F.col("a").alias("id")).union(live.select("b")).distinct()
    colours = _spread(live, nodes.withColumn("label", F.col("id")), every)
    same = (
        live.join(colours.select(F.col("id").alias("a"), F.col("label").alias("la")), "a")
        .join(colours.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
        .where("la = lb")
        .select(F.col("la").alias("label"), F.col("b").alias("a"), F.col("a").alias("b"))
    )
    reached = _reach(materialise(same), colours.where("id = label").select("id", "label"), every)
    return materialise(reached.select("id", F.col("label").alias("root")))


def _spread(edges: DataFrame, labels: DataFrame, every: int) -> DataFrame:
    """Forward fixpoint of the smallest label.

    ``was`` remembers the label before the last few rounds, so the stop test is
    a filter on the written table.
    """
    while True:
        current = labels.withColumn("was", F.col("label"))
        for _ in range(every):
            sent = edges.join(current.select(F.col("id").alias("a"), "label"), "a").select(
                F.col("b").alias("id"), "label", F.lit(None).cast("long").alias("was")
            )
            current = (
                current.unionByName(sent).groupBy("id").agg(F.min("label").alias("label"), F.max("was").alias("was"))
            )
        current = materialise(current)
        labels = current.drop("was")
        if current.where("label <> was").isEmpty():
            return labels


def _reach(edges: DataFrame, seeds: DataFrame, every: int) -> DataFrame:
    """Files reached from the seeds along edges of the same label."""
    seen, size = seeds, -1
    while True:
        current = seen
        for _ in range(every):
            sent = edges.join(current.select(F.col("id").alias("a"), "label"), ["a", "label"]).select(
                F.col("b").alias("id"), "label"
            )
            current = current.unionByName(sent).distinct()
        current = materialise(current)
        grown = current.count()
        seen = current
        if grown == size:
            return seen
        size = grown
