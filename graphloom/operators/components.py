"""Strongly connected components and the levels of their order.

Packages of up to ``SMALL`` rows are worked on whole, many to a task: one depth-first walk gives the components, each after
all that it leads to, and so the levels as well.

A larger package is split by all executors: nodes without an edge in or out are components of their own; from a pivot of
each part what it reaches and what reaches it is followed (``reach``), what is in both is a component, and what is in
the one, in the other and in neither are three parts that no component spans. The parts are worked on at once, each
as a package of its own, so that those that became small go the first way. Levels of a large package: its condensation is
contracted, which leaves the leaves and what branches, and the longest ways are relaxed there and carried back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import SMALL, dealt, reach, whole_packages, written
from .contraction import contracted

_OUT = "package_id string, node long, component long, level int"


def walked(begin: list[int], dst: list[int]) -> list[list[int]]:
    """The components of a graph (the targets of node v are dst[begin[v]:begin[v + 1]]), each after all that it leads to."""
    n = len(begin) - 1
    order, low, open_ = [0] * n, [0] * n, [False] * n
    found: list[list[int]] = []
    held: list[int] = []
    count = 0
    for root in range(n):
        if order[root]:
            continue
        walk = [(root, begin[root])]
        count += 1
        order[root] = low[root] = count
        held.append(root)
        open_[root] = True
        while walk:
            v, at = walk[-1]
            if at < begin[v + 1]:
                walk[-1] = (v, at + 1)
                w = dst[at]
                if not order[w]:
                    count += 1
                    order[w] = low[w] = count
                    held.append(w)
                    open_[w] = True
                    walk.append((w, begin[w]))
                elif open_[w]:
                    low[v] = min(low[v], order[w])
                continue
            walk.pop()
            if walk:
                low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
            if low[v] == order[v]:
                found.append([])
                while not found[-1] or found[-1][-1] != v:
                    w = held.pop()
                    open_[w] = False
                    found[-1].append(w)
    return found


def coded(package: np.ndarray, ends: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different nodes (package, id), sorted, and the places of ends (ids, as many as packages) among them."""
    pairs = np.concatenate([np.stack((package, e), 1) for e in ends])
    nodes, code = np.unique(pairs, axis=0, return_inverse=True)
    return nodes, np.split(code.reshape(-1), len(ends))


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_packages(batches):
        package, at = np.unique(table.column("package_id").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        nodes, (a, b) = coded(at, [table.column("src").to_numpy(), table.column("dst").to_numpy()])
        step = np.unique(np.stack((a, b), 1)[a != b], axis=0)
        begin = np.searchsorted(step[:, 0], np.arange(len(nodes) + 1)).tolist()
        dst = step[:, 1].tolist()
        component, level = np.empty(len(nodes), np.int64), np.zeros(len(nodes), np.int32)
        for members in walked(begin, dst):
            component[members] = nodes[min(members), 1]  # nodes are sorted
            below = [w for v in members for w in dst[begin[v] : begin[v + 1]]]
            inside = set(members)
            level[members] = max((level[w] + 1 for w in below if w not in inside), default=0)
        for lo in range(0, len(nodes), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            yield pa.record_batch([pa.array(package[nodes[s, 0]].tolist(), pa.string()), pa.array(nodes[s, 1]), pa.array(component[s]), pa.array(level[s])], names=["package_id", "node", "component", "level"])


def _rows(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    rows = edges.select("package_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    if nodes is not None:
        rows = rows.unionByName(nodes.select("package_id", F.col("node").cast("long").alias("src"), F.col("node").cast("long").alias("dst")))
    return written(rows.where("package_id is not null and src is not null and dst is not null").distinct())


def _parts(rows: DataFrame, small: int) -> DataFrame:
    """package_id, node, component of packages of more than small rows."""
    key = ["package_id", "part"]
    name = F.concat_ws("\0", "package_id", "part").alias("package_id")
    rows, found, rounds = rows.withColumn("part", F.lit("")), [], 0
    while True:
        size = rows.groupBy(*key).count()
        big = written(size.where(F.col("count") > small).select(*key))
        few = rows.join(big, key, "left_anti")
        done = dealt(few.select(name, "src", "dst")).mapInArrow(_walk, _OUT)
        found.append(written(done.select(F.substring_index("package_id", "\0", 1).alias("package_id"), "node", "component")))
        if big.isEmpty():
            return reduce(DataFrame.unionByName, found)
        rows = rows.join(big, key, "left_semi")
        nodes = written(rows.select(*key, F.col("src").alias("node")).unionByName(rows.select(*key, F.col("dst").alias("node"))).distinct())
        true = rows.where("src <> dst")
        inner = nodes.join(true.select(*key, F.col("src").alias("node")), [*key, "node"], "left_semi").join(true.select(*key, F.col("dst").alias("node")), [*key, "node"], "left_semi")
        inner = written(inner)
        found.append(nodes.join(inner, [*key, "node"], "left_anti").select("package_id", "node", F.col("node").alias("component")))
        true = written(true.join(inner.withColumnRenamed("node", "src"), [*key, "src"], "left_semi").join(inner.withColumnRenamed("node", "dst"), [*key, "dst"], "left_semi"))
        pivot = written(inner.groupBy(*key).agg(F.min_by("node", F.xxhash64("node", F.lit(rounds))).alias("node")))
        steps, seed = true.select(name, "src", "dst"), pivot.select(name, F.col("node").alias("origin"), "node")
        ahead, behind = (reach(steps, seed, 0, backward=b).select("package_id", "node", F.lit(True).alias("ahead" if not b else "behind")) for b in (False, True))
        split = inner.withColumn("at", F.concat_ws("\0", "package_id", "part"))
        for side in (ahead, behind):
            split = split.join(side.withColumnRenamed("package_id", "at"), ["at", "node"], "left")
        split = written(split.select(*key, "node", F.coalesce("ahead", F.lit(False)).alias("ahead"), F.coalesce("behind", F.lit(False)).alias("behind")))
        both = split.where("ahead and behind")
        least = both.groupBy(*key).agg(F.min("node").alias("component"))
        found.append(written(both.join(least, key).select("package_id", "node", "component")))
        # hashes keep the names of parts short; parts that share one are only worked on together
        rest = split.where("not (ahead and behind)").select("package_id", "node", F.hex(F.xxhash64("part", "ahead", "behind")).alias("part"))
        ends = true.select("package_id", "src", "dst")
        ends = ends.join(rest.select("package_id", F.col("node").alias("src"), "part"), ["package_id", "src"]).join(rest.select("package_id", F.col("node").alias("dst"), F.col("part").alias("other")), ["package_id", "dst"])
        lone = rest.select("package_id", F.col("node").alias("src"), F.col("node").alias("dst"), "part")
        rows = written(ends.where("part = other").select("package_id", "src", "dst", "part").unionByName(lone).distinct())
        rounds += 1


def _levels(rows: DataFrame, found: DataFrame) -> DataFrame:
    """package_id, node (a component), level."""
    of = lambda c, to: found.select("package_id", F.col("node").alias(c), F.col("component").alias(to))
    between = rows.join(of("src", "a"), ["package_id", "src"]).join(of("dst", "b"), ["package_id", "dst"]).where("a <> b")
    back = written(between.select("package_id", F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(1).alias("value")).distinct())
    nodes = found.select("package_id", F.col("component").alias("node")).distinct()
    leaves = written(nodes.join(back.select("package_id", F.col("dst").alias("node")), ["package_id", "node"], "left_anti"))
    core, taken = contracted(back, leaves, lambda x, y: x + y, F.max)
    known = leaves.withColumn("level", F.lit(0))
    heads = written(core.select("package_id", F.col("dst").alias("node")).distinct().join(leaves, ["package_id", "node"], "left_anti"))
    new = known
    while not new.isEmpty():  # a node is done when all it leads to are
        ready = core.join(known.select("package_id", F.col("node").alias("src"), "level"), ["package_id", "src"], "left").groupBy("package_id", F.col("dst").alias("node"))
        ready = ready.agg(F.bool_and(F.col("level").isNotNull()).alias("all"), F.max(F.col("level") + F.col("value")).alias("level")).where("all").drop("all")
        new = written(ready.join(heads, ["package_id", "node"], "left_semi"))
        heads = written(heads.join(new, ["package_id", "node"], "left_anti"))
        known = written(known.unionByName(new))
    for into in reversed(taken):
        more = into.join(known.select("package_id", F.col("node").alias("src"), "level"), ["package_id", "src"]).groupBy("package_id", F.col("dst").alias("node")).agg(F.max(F.col("level") + F.col("value")).alias("level"))
        known = written(known.unionByName(more))
    return known


def strong_components(edges: DataFrame, nodes: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """package_id, node, component, level of every node of edges (package_id, src, dst) and of nodes (package_id, node).

    component: the smallest node of those that reach each other; level: the longest way out of it, in components, so that
    what has no other component to lead to is 0 and in the order of levels everything comes after what it leads to.
    Loops and repeated edges are allowed; rows with a null are left out.
    """
    rows = _rows(edges, nodes)
    size = rows.groupBy("package_id").count()
    big = written(size.where(F.col("count") > small).select("package_id"))
    few = dealt(rows.join(big, "package_id", "left_anti")).mapInArrow(_walk, _OUT)
    if big.isEmpty():
        return few
    rows = written(rows.join(big, "package_id", "left_semi"))
    found = written(_parts(rows, small))
    levels = _levels(rows, found).withColumnRenamed("node", "component")
    return few.unionByName(found.join(levels, ["package_id", "component"]).select("package_id", "node", "component", F.col("level").cast("int").alias("level")))
