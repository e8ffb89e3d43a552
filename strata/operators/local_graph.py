"""Strongly connected groups of a graph that fits in a task: one block of a larger one."""

from __future__ import annotations

from collections import deque

import pandas as pd


def groups(successors: dict[int, list[int]]) -> dict[int, int]:
    """Smallest member of every node's strongly connected group (Tarjan, without recursion)."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    out: dict[int, int] = {}
    stack: list[int] = []
    for start in successors:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        path = [(start, iter(successors[start]))]
        while path:
            node, rest = path[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    path.append((nxt, iter(successors.get(nxt, ()))))
                    break
                if nxt not in out:
                    low[node] = min(low[node], index[nxt])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == index[node]:
                    at = len(stack) - 1
                    while stack[at] != node:
                        at -= 1
                    members = stack[at:]
                    del stack[at:]
                    first = min(members)
                    for member in members:
                        out[member] = first
    return out


def _successors(a: pd.Series, b: pd.Series) -> dict[int, list[int]]:
    edges: dict[int, list[int]] = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        edges.setdefault(x, []).append(y)
        edges.setdefault(y, [])
    return edges


def contracted(a: pd.Series, b: pd.Series) -> list[tuple[int, int | None, int | None]]:
    """What is left of a block: rows (a, b, null) for edges, (id, null, root) for files that became ``root`` or, with null, went.

    A row with one end tells that the file has an edge out of (b null) or into (a null) the
    block. Files without such an edge go when nothing leads to them or from them, or when
    bridging them adds no more edges than they have.
    """
    leaves = set(a[b.isna()].astype("int64").tolist())
    enters = set(b[a.isna()].astype("int64").tolist())
    whole = a.notna() & b.notna()
    edges = _successors(a[whole].astype("int64"), b[whole].astype("int64"))
    for node in leaves | enters:
        edges.setdefault(node, [])
    root = groups(edges)
    after: dict[int, set[int]] = {r: set() for r in root.values()}
    before: dict[int, set[int]] = {r: set() for r in after}
    for x, targets in edges.items():
        for y in targets:
            if root[x] != root[y]:
                after[root[x]].add(root[y])
                before[root[y]].add(root[x])
    leaves, enters = {root[n] for n in leaves}, {root[n] for n in enters}
    gone: set[int] = set()
    queue = deque(after)
    while queue:
        node = queue.popleft()
        if node in gone:
            continue
        ins, outs = before[node], after[node]
        dead = (not ins and node not in enters) or (not outs and node not in leaves)
        free = node not in enters and node not in leaves
        if not dead and not (free and len(ins) * len(outs) <= len(ins) + len(outs)):
            continue
        gone.add(node)
        for p in ins:
            after[p].discard(node)
        for q in outs:
            before[q].discard(node)
        if not dead:
            for p in ins:
                after[p] |= outs
            for q in outs:
                before[q] |= ins
        queue.extend(ins)
        queue.extend(outs)
    rows: list[tuple[int, int | None, int | None]] = [(x, y, None) for x in after if x not in gone for y in after[x]]
    rows += [(n, None, None if r in gone else r) for n, r in root.items() if r in gone or n != r]
    return rows


def grouped_files(a: pd.Series, b: pd.Series) -> list[tuple[int, None, int]]:
    """(id, null, root) of the files in groups of two or more; a negative file -1 - root gives its group that root."""
    root = groups(_successors(a.astype("int64"), b.astype("int64")))
    sizes: dict[int, int] = {}
    for r in root.values():
        sizes[r] = sizes.get(r, 0) + 1
    return [(n, None, -1 - r if r < 0 else r) for n, r in root.items() if sizes[r] > 1]
