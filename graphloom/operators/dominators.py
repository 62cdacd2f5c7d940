"""Dominators of control-flow graphs, and from them the version of each variable at each node.

A node is dominated by those that every way to it passes. Packages of up to ``SMALL`` rows are solved whole, many to a
task, by intersecting ancestors in reverse postorder until nothing changes. A larger package is solved by all executors:
a tree of ways from the roots is held as a table of parents; in each round every edge that does not lead from a parent asks
for the nearest common ancestor of its two ends, found with jump pointers (each table the one before, joined to itself), and
a node moves up to the highest that its edges ask for. When no node moves, parents are immediate dominators. Rounds: the
hops of the widest search, then those in which nodes move; each is some joins for every doubling of the tree's depth.

A node without an immediate dominator (a root, or one to which different roots lead) has null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .closure import SMALL, dealt, reach, spans, whole_packages, written
from .dataflow import reaching_definitions

_ABOVE = -(1 << 63)  # stands for what leads to all roots
_NODE = ["package_id", "node"]


def immediate(edges: list[tuple[int, int]], roots: list[int]) -> dict[int, int | None]:
    """The immediate dominator of each node of one package that a root leads to."""
    after: dict[int | None, list[int]] = {None: sorted(set(roots))}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    order: list[int | None] = []
    seen: set[int | None] = {None}
    stack = [(None, iter(after[None]))]
    while stack:
        v, rest = stack[-1]
        w = next((w for w in rest if w not in seen), None)
        if w is None:
            order.append(stack.pop()[0])
        else:
            seen.add(w)
            stack.append((w, iter(after.get(w, ()))))
    number = {v: i for i, v in enumerate(order)}  # the later, the nearer to the roots
    top = len(order) - 1
    before: list[list[int]] = [[] for _ in order]
    for v, i in number.items():
        for w in after.get(v, ()):
            before[number[w]].append(i)
    parent = [-1] * len(order)
    parent[top] = top
    moved = True
    while moved:
        moved = False
        for i in range(top - 1, -1, -1):
            best = -1
            for j in before[i]:
                if parent[j] < 0:
                    continue
                while best >= 0 and j != best:
                    j, best = (parent[j], best) if j < best else (j, parent[best])
                best = j
            if best != parent[i]:
                parent[i], moved = best, True
    return {order[i]: order[parent[i]] for i in range(top)}


def frontier_of(edges: list[tuple[int, int]], parent: dict[int, int | None]) -> set[tuple[int, int]]:
    """(node, join): the nodes where what a node dominates ends, of one package."""
    out: set[tuple[int, int]] = set()
    for p, w in edges:
        if p not in parent or w not in parent:
            continue
        v: int | None = p
        while v is not None and v != parent[w] and (v, w) not in out:
            out.add((v, w))
            v = parent[v]
    return out


def _packages(solve: Callable[[list, list], Iterable[tuple]], names: list[str]):
    """Rows (a, b, kind) of whole packages; solve gets those of kind 0 and those of kind 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_packages(batches):
            packages, parts = spans(table)
            a, kind = table.column("a").to_numpy().tolist(), table.column("kind").to_numpy().tolist()
            b = table.column("b").fill_null(0).to_numpy().astype(object)
            b[table.column("b").is_null().to_numpy()] = None
            b = b.tolist()
            rows: list[tuple] = []
            of: list[int] = []
            for i, (begin, end) in enumerate(parts):
                kinds: tuple[list, list] = ([], [])
                for j in range(begin, end):
                    kinds[kind[j]].append((a[j], b[j]))
                for row in solve(*kinds):
                    rows.append(row)
                    of.append(i)
                    if len(rows) == 1 << 15:
                        yield _batch(packages, of, rows, names)
                        rows, of = [], []
            if rows:
                yield _batch(packages, of, rows, names)

    return run


def _batch(packages: pa.Array, of: list[int], rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    ids = zip(*rows, strict=True)
    return pa.record_batch([packages.take(pa.array(np.array(of))), *(pa.array(x, pa.int64()) for x in ids)], names=["package_id", *names])


def _dealt_or_joined(edges: DataFrame, others: DataFrame, solve, names: list[str], large: Callable[[DataFrame, DataFrame], DataFrame], small: int) -> DataFrame:
    """solve for each small package in a task, large (edges (a, b), others (a, b)) for the rest."""
    rows = edges.select("package_id", F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.lit(0).alias("kind")).where("b is not null").unionByName(others.withColumn("kind", F.lit(1)))
    rows = written(rows.where("package_id is not null and a is not null").distinct())
    big = written(rows.groupBy("package_id").count().where(F.col("count") > small).select("package_id"))
    few = dealt(rows.join(big, "package_id", "left_anti")).mapInArrow(_packages(solve, names), ", ".join(["package_id string", *(f"{n} long" for n in names)]))
    if big.isEmpty():
        return few
    rows = written(rows.join(big, "package_id", "left_semi"))
    return few.unionByName(large(rows.where("kind = 0").drop("kind"), rows.where("kind = 1").drop("kind")))


def _tree(edges: DataFrame) -> DataFrame:
    """package_id, node, parent: for each node that is led to, an edge from a node that is fewer hops away."""
    known = new = written(edges.where(F.col("a") == _ABOVE).select("package_id", F.col("b").alias("node"), F.lit(_ABOVE).alias("parent")).distinct())
    while not new.isEmpty():
        found = new.select("package_id", F.col("node").alias("a")).join(edges, ["package_id", "a"]).groupBy("package_id", F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        new = written(found.join(known, _NODE, "left_anti"))
        known = written(known.unionByName(new))
    return known


def _jumps(parents: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestors 1, 2, 4 .. steps up (package_id, node, up); the depth of each node. What leads to the roots is its own ancestor."""
    above = parents.select("package_id").distinct().select("package_id", F.lit(_ABOVE).alias("node"), F.lit(_ABOVE).alias("up"), F.lit(0).cast("long").alias("depth"))
    step = written(above.unionByName(parents.select("package_id", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"))))
    jumps = [step]
    while not step.where(F.col("up") != _ABOVE).isEmpty():
        on = step.select("package_id", F.col("node").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"))
        step = written(step.join(on, ["package_id", "up"]).select("package_id", "node", F.col("far").alias("up"), (F.col("depth") + F.col("more")).alias("depth")))
        jumps.append(step)
    return jumps, step.select("package_id", "node", "depth")


def _climb(rows: DataFrame, jump: DataFrame, of: str, to: str) -> DataFrame:
    return rows.join(jump.select("package_id", F.col("node").alias(of), F.col("up").alias(to)), ["package_id", of])


def _common(rows: DataFrame, jumps: list[DataFrame], depth: DataFrame) -> DataFrame:
    """rows (package_id, w, x, y) with the nearest common ancestor of x and y as common."""
    deep = lambda c: depth.select("package_id", F.col("node").alias(c), F.col("depth").alias(f"d{c}"))
    rows = rows.join(deep("x"), ["package_id", "x"]).join(deep("y"), ["package_id", "y"])
    swap = F.col("dx") < F.col("dy")
    rows = written(rows.select("package_id", "w", F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"), F.abs(F.col("dx") - F.col("dy")).alias("lift")))
    for k in reversed(range(len(jumps))):
        go = F.col("lift") >= 1 << k
        rows = _climb(rows, jumps[k], "x", "u").select("package_id", "w", F.when(go, F.col("u")).otherwise(F.col("x")).alias("x"), "y", F.when(go, F.col("lift") - (1 << k)).otherwise(F.col("lift")).alias("lift"))
        rows = written(rows) if k % 4 == 0 else rows
    for k in reversed(range(len(jumps))):
        go = F.col("u") != F.col("v")
        rows = _climb(_climb(rows, jumps[k], "x", "u"), jumps[k], "y", "v").select("package_id", "w", F.when(go, F.col("u")).otherwise(F.col("x")).alias("x"), F.when(go, F.col("v")).otherwise(F.col("y")).alias("y"))
        rows = written(rows) if k % 3 == 0 else rows
    return _climb(rows, jumps[0], "x", "u").select("package_id", "w", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("u")).alias("common"))


def _large_dominators(edges: DataFrame, roots: DataFrame) -> DataFrame:
    fine = lambda c: F.when(F.col(c) != _ABOVE, F.col(c)).otherwise(F.raise_error(F.lit("a node has the smallest long as its id")).cast("long")).alias(c)
    edges = edges.where("a <> b").select("package_id", fine("a"), fine("b")).unionByName(roots.select("package_id", F.lit(_ABOVE).alias("a"), fine("a").alias("b")))
    edges = written(edges.distinct())
    parents = _tree(edges)
    led = parents.select("package_id", F.col("node").alias("a")).unionByName(parents.select("package_id", F.lit(_ABOVE).alias("a")).distinct())
    edges = written(edges.join(led, ["package_id", "a"], "left_semi"))
    while True:
        jumps, depth = _jumps(parents)
        asked = edges.join(parents.withColumnRenamed("node", "b"), ["package_id", "b"]).where("a <> parent").select("package_id", F.col("b").alias("w"), F.col("a").alias("x"), F.col("parent").alias("y"))
        found = _common(asked, jumps, depth).join(depth.withColumnRenamed("node", "common"), ["package_id", "common"])
        highest = found.groupBy("package_id", F.col("w").alias("node")).agg(F.min_by("common", "depth").alias("common"))
        moved = written(highest.join(parents, _NODE).where("common <> parent").select(*_NODE, F.col("common").alias("parent")))
        if moved.isEmpty():
            return parents.select(*_NODE, F.when(F.col("parent") != _ABOVE, F.col("parent")).alias("idom"))
        parents = written(parents.join(moved.select(*_NODE), _NODE, "left_anti").unionByName(moved))


def dominators(edges: DataFrame, roots: DataFrame, small: int = SMALL) -> DataFrame:
    """package_id, node, idom: the immediate dominator of each node that roots (package_id, node) lead to over edges (package_id, src, dst). Rows with nulls are left out, repeated ones count once."""
    roots = roots.select("package_id", F.col("node").cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    return _dealt_or_joined(edges, roots, lambda e, r: immediate(e, [a for a, _ in r]).items(), ["node", "idom"], _large_dominators, small)


def _large_frontiers(edges: DataFrame, idoms: DataFrame) -> DataFrame:
    up = written(idoms.select("package_id", F.col("a").alias("node"), F.col("b").alias("idom")))
    stop = up.select("package_id", F.col("node").alias("b"), F.col("idom").alias("stop"))
    new = edges.join(stop, ["package_id", "b"]).join(up.select("package_id", F.col("node").alias("a")), ["package_id", "a"], "left_semi")
    below: Column = ~F.col("node").eqNullSafe(F.col("stop")) & F.col("node").isNotNull()
    new = written(new.select("package_id", F.col("a").alias("node"), F.col("b").alias("join"), "stop").where(below))
    parts = [new]
    while not new.isEmpty():
        found = new.join(up, _NODE).select("package_id", F.col("idom").alias("node"), "join", "stop").where(below).distinct()
        new = written(found.join(reduce(DataFrame.unionByName, parts), ["package_id", "node", "join"], "left_anti"))
        parts.append(new)
        if len(parts) > 8:
            parts = [written(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts).select("package_id", "node", "join")


def frontiers(edges: DataFrame, idoms: DataFrame, small: int = SMALL) -> DataFrame:
    """package_id, node, join: the dominance frontier of each node of idoms, the rows of ``dominators``. In large packages a round for each step of the dominator tree."""
    idoms = idoms.select("package_id", F.col("node").alias("a"), F.col("idom").alias("b"))
    return _dealt_or_joined(edges, idoms, lambda e, d: frontier_of(e, dict(d)), ["node", "join"], _large_frontiers, small)


def versions(edges: DataFrame, roots: DataFrame, definitions: DataFrame, small: int = SMALL) -> DataFrame:
    """package_id, node, variable, version, is_join: which one version of each variable a node reads, if it reads it.

    A version is made by a definition (package_id, node, variable string) or, where different versions meet, by the node at
    which they do (is_join). Nodes to which no root leads have none. A variable not yet defined on some way is a version too,
    so a definition on one branch gives a join; a node has a row for a variable only if one of its versions dominates it.
    """
    edges = written(edges.select("package_id", "src", "dst"))  # read twice
    idoms = written(dominators(edges, roots, small))
    own = definitions.select("package_id", F.col("node").cast("long").alias("node"), "variable").where("variable is not null").distinct()
    own = written(own.join(idoms.select(*_NODE), _NODE, "left_semi"))
    meets = reach(frontiers(edges, idoms, small).select("package_id", F.col("node").alias("src"), F.col("join").alias("dst")), own.select("package_id", F.col("node").alias("origin"), "node").distinct(), small=small)
    meets = own.withColumnRenamed("node", "origin").join(meets, ["package_id", "origin"]).select(*_NODE, "variable").distinct()
    # a node is two: at 2 node versions meet, at 2 node + 1 it defines; down the tree the nearest version is the only one that is left
    twice = lambda c: F.when(F.abs(c) < 1 << 61, c * 2).when(c.isNotNull(), F.raise_error(F.lit("a node id is too large")).cast("long"))
    node = twice(F.col("node"))
    tree = idoms.select("package_id", node.alias("src"), (node + 1).alias("dst")).unionByName(idoms.where("idom is not null").select("package_id", (twice(F.col("idom")) + 1).alias("src"), node.alias("dst")))
    made = own.select("package_id", (node + 1).alias("node"), "variable").unionByName(meets.select("package_id", node.alias("node"), "variable"))
    found = reaching_definitions(tree, made, small).where("node & 1 = 1")
    return found.select("package_id", F.shiftright("node", 1).alias("node"), "variable", F.shiftright("definition", 1).alias("version"), (F.col("definition").bitwiseAND(1) == 0).alias("is_join"))
