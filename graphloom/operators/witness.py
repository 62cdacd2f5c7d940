"""Witness paths: not only that a goal is reached, but a shortest path of edges to it.

Of the shortest paths from an origin's seeds to a node the one whose edge ids are the smallest, compared from the first
on, is the witness; so the result does not depend on how rows are dealt.

Packages of up to ``SMALL`` rows (and ``PAIRS`` pairs of an edge end and a seed) are searched whole, many to a task: breadth
first from all origins at once, with one predecessor kept for each pair of an origin and a node, then back from all goals at
once, a hop at a time. A larger package is first contracted (all but seeds, goals and what branches goes, edges carry the
ids they stand for), so that a long chain takes a number of rounds that grows with its logarithm; distances are then relaxed
over what is left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .closure import PAIRS, SMALL, dealt, whole_packages, written
from .components import coded
from .contraction import contracted

_OUT = "package_id string, origin long, node long, path array<bigint>"


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by package: edges (a, b, id), seeds (origin a, node b) and goals (origin a, node b)."""
    for table in whole_packages(batches):
        package, at = np.unique(table.column("package_id").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        kind = table.column("kind").to_numpy()
        a, b, number = (table.column(c).to_numpy() for c in ("a", "b", "id"))
        edge, seed, goal = (np.flatnonzero(kind == k) for k in (0, 1, 2))
        ends = np.concatenate((np.stack((at[edge], a[edge]), 1), np.stack((at[edge], b[edge]), 1), np.stack((at[seed], b[seed]), 1), np.stack((at[goal], b[goal]), 1)))
        nodes, code = np.unique(ends, axis=0, return_inverse=True)
        src, dst, start, wanted = np.split(code.reshape(-1), np.cumsum([len(edge), len(edge), len(seed)]))
        origins, origin = coded(np.concatenate((at[seed], at[goal])), [np.concatenate((a[seed], a[goal]))])
        own, asked = np.split(origin[0], [len(seed)])
        order = np.lexsort((number[edge], src))
        src, dst, number = src[order], dst[order], number[edge][order]
        begin = np.searchsorted(src, np.arange(len(nodes) + 1))
        first = np.searchsorted(nodes[:, 0], np.arange(len(package) + 1))  # nodes of a package are together
        base = np.concatenate(([0], np.cumsum((first[1:] - first[:-1])[origins[:, 0]])))
        shift = base[:-1] - first[origins[:, 0]]  # place of a pair of an origin and a node
        by = np.full(int(base[-1]), -2, np.int64)  # the edge it was reached over; -1: a seed, -2: not reached
        o, v = np.unique(np.stack((own, start), 1), axis=0).T
        by[shift[o] + v] = -1
        rank = np.zeros(len(o), np.int64)  # of the paths, equal where they are
        while len(o):
            count = begin[v + 1] - begin[v]
            last = np.cumsum(count)
            if not last[-1]:
                break
            place = np.arange(last[-1]) + np.repeat(begin[v] - (last - count), count)
            o, rank = np.repeat(o, count), np.repeat(rank, count)
            bit = shift[o] + dst[place]
            new = np.flatnonzero(by[bit] == -2)
            new = new[np.lexsort((number[place[new]], rank[new], o[new]))]
            _, one = np.unique(bit[new], return_index=True)
            path = np.stack((o[new], rank[new], number[place[new]]))
            rank = np.cumsum(np.append(0, (path[:, 1:] != path[:, :-1]).any(0)))[: len(new)]
            one = np.sort(one)  # the first way to each
            new, rank = new[one], rank[one]
            by[bit[new]] = place[new]
            o, v = o[new], dst[place[new]]
        found = np.flatnonzero(by[shift[asked] + wanted] != -2)
        o, v, which = asked[found], wanted[found], np.arange(len(found))
        steps, owner = [], []
        while len(which):
            back = by[shift[o] + v]
            go = np.flatnonzero(back >= 0)
            o, v, which, back = o[go], src[back[go]], which[go], back[go]
            steps.append(number[back])
            owner.append(which)
        every, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (steps, owner))
        turn = np.lexsort((-np.arange(len(owner)), owner))  # from the first edge on
        offsets = np.searchsorted(owner[turn], np.arange(len(found) + 1))
        o, v = asked[found], wanted[found]
        for lo in range(0, len(found), 1 << 14):
            s = slice(lo, min(lo + (1 << 14), len(found)))
            flat = every[turn[offsets[s.start] : offsets[s.stop]]]
            lists = pa.ListArray.from_arrays(pa.array((offsets[s.start : s.stop + 1] - offsets[s.start]).astype(np.int32)), pa.array(flat))
            yield pa.record_batch([pa.array(package[origins[o[s], 0]].tolist(), pa.string()), pa.array(origins[o[s], 1]), pa.array(nodes[v[s], 1]), lists], names=["package_id", "origin", "node", "path"])


def _longer(near: Column, far: Column) -> Column:
    return F.struct((near["n"] + far["n"]).alias("n"), F.concat(near["path"], far["path"]).alias("path"))


def _large(edges: DataFrame, seeds: DataFrame, goals: DataFrame) -> DataFrame:
    one = F.struct(F.lit(1).alias("n"), F.array("id").alias("path"))
    kept = written(seeds.select("package_id", "node").unionByName(goals.select("package_id", "node")).distinct())
    core, _ = contracted(edges.select("package_id", "src", "dst", one.alias("value")), kept, _longer, F.min)
    core = written(core.select("package_id", F.col("src").alias("node"), "dst", F.col("value").alias("far")))
    key = ["package_id", "origin", "node"]
    none = F.struct(F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("path"))
    known = new = written(seeds.select(*key, none.alias("value")).distinct())
    while not new.isEmpty():
        ways = new.join(core, ["package_id", "node"]).select("package_id", "origin", F.col("dst").alias("node"), _longer(F.col("value"), F.col("far")).alias("value"))
        best = ways.groupBy(*key).agg(F.min("value").alias("better")).join(known, key, "left")
        new = written(best.where("value is null or better < value").select(*key, F.col("better").alias("value")))
        known = written(known.join(new.select(*key), key, "left_anti").unionByName(new))
    return goals.join(known, key).select(*key, "value.path")


def shortest_paths(edges: DataFrame, seeds: DataFrame, goals: DataFrame, small: int = SMALL) -> DataFrame:
    """package_id, origin, node, path: for each goal (package_id, origin, node) that its origin's seeds (package_id, origin, node) reach, the ids of the edges (package_id, edge_id, src, dst) on the witness, from the first on; a goal that is a seed has an empty one."""
    ids = [F.col(c).cast("long") for c in ("src", "dst", "edge_id")]
    rows = edges.select("package_id", F.lit(0).alias("kind"), ids[0].alias("a"), ids[1].alias("b"), ids[2].alias("id"))
    for kind, ends in ((1, seeds), (2, goals)):
        rows = rows.unionByName(ends.select("package_id", F.lit(kind).alias("kind"), F.col("origin").cast("long").alias("a"), F.col("node").cast("long").alias("b"), F.lit(0).cast("long").alias("id")).distinct())
    rows = written(rows.where("package_id is not null and a is not null and b is not null and id is not null"))
    pairs = F.count_if(F.col("kind") == 0) * F.count_if(F.col("kind") == 1)
    size = rows.groupBy("package_id").agg(F.count("*").alias("n"), pairs.alias("pairs"))
    big = written(size.where((F.col("n") > small) | (F.col("pairs") > PAIRS)).select("package_id"))
    few = dealt(rows.join(big, "package_id", "left_anti")).mapInArrow(_search, _OUT)
    if big.isEmpty():
        return few
    rows = written(rows.join(big, "package_id", "left_semi"))
    part = lambda kind: rows.where(F.col("kind") == kind).select("package_id", F.col("a").alias("origin"), F.col("b").alias("node"))
    large = _large(rows.where("kind = 0").select("package_id", F.col("a").alias("src"), F.col("b").alias("dst"), "id"), part(1), part(2))
    return few.unionByName(large.select("package_id", "origin", "node", "path"))
