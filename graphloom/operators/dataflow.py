"""Dataflow with kills over control-flow graphs: which definitions of a variable reach each node.

A definition reaches a node's entry over a path on which no node between defines the variable anew. Branches meet by union,
loops are followed to the least fixpoint.

Packages of up to ``SMALL`` rows (and ``BITS`` pairs of a node and a definition) are solved whole, many to a task: a bit for
each definition, gen and kill sets of each node as bitmaps, and a worklist of the nodes whose entry changed. In a larger
package nodes without definitions are contracted first, what is left is followed hop by hop by joins, stopping where a
variable is defined, and the nodes that were taken out are filled in.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import SMALL, dealt, spans, whole_packages, written
from .contraction import contracted

BITS = 1 << 28
_OUT = "package_id string, node long, variable string, definition long"


def solved(edges: list[tuple[int, int]], definitions: list[tuple[int, str | int]]) -> Iterator[tuple[int, str | int, int]]:
    """(node, variable, definition) of one package."""
    bits = sorted(set(definitions))
    of_variable: dict[str, int] = {}
    gen: dict[int, int] = {}
    for i, (node, variable) in enumerate(bits):
        of_variable[variable] = of_variable.get(variable, 0) | 1 << i
        gen[node] = gen.get(node, 0) | 1 << i
    keep = {}
    for node, variable in bits:
        keep[node] = keep.get(node, -1) & ~of_variable[variable]
    after: dict[int, set[int]] = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    entry: dict[int, int] = {}
    work, waiting = deque(sorted(gen)), set(gen)
    while work:
        v = work.popleft()
        waiting.discard(v)
        out = entry.get(v, 0) & keep.get(v, -1) | gen.get(v, 0)
        for w in after.get(v, ()):
            old = entry.get(w, 0)
            if out | old != old:
                entry[w] = out | old
                if w not in waiting:
                    waiting.add(w)
                    work.append(w)
    for v, held in entry.items():
        while held:
            low = held & -held
            node, variable = bits[low.bit_length() - 1]
            yield v, variable, node
            held ^= low


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["package_id", "node", "variable", "definition"]
    for table in whole_packages(batches):
        packages, parts = spans(table)
        coded = table.column("variable").combine_chunks().dictionary_encode()  # edges have none
        of_row = coded.indices.fill_null(0).to_numpy().tolist()
        a, b = table.column("a").to_numpy().tolist(), table.column("b").fill_null(0).to_numpy().tolist()
        edge = table.column("b").is_valid().to_numpy().tolist()

        def batch(of: list[int], rows: list[tuple]) -> pa.RecordBatch:
            node, variable, definition = (np.array(x) for x in zip(*rows, strict=True))
            return pa.record_batch([packages.take(pa.array(np.array(of))), pa.array(node), coded.dictionary.take(pa.array(variable)), pa.array(definition)], names=names)

        rows: list[tuple] = []
        of: list[int] = []
        for i, (begin, end) in enumerate(parts):
            edges = [(a[j], b[j]) for j in range(begin, end) if edge[j]]
            definitions = [(a[j], of_row[j]) for j in range(begin, end) if not edge[j]]
            for row in solved(edges, definitions):
                rows.append(row)
                of.append(i)
                if len(rows) == 1 << 15:
                    yield batch(of, rows)
                    rows, of = [], []
        if rows:
            yield batch(of, rows)


def _large(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    own = written(definitions.select("package_id", "node", "variable").distinct())
    # a node with definitions is two, its entry (2 node) and its exit (2 node + 1), so that what leads from it to itself is an edge
    twice = lambda c: F.when(F.abs(c) < 1 << 61, c * 2).when(c.isNotNull(), F.raise_error(F.lit("a node id is too large")).cast("long"))
    split = own.select("package_id", F.col("node").alias("src"), F.lit(1).alias("exit")).distinct()
    edges = edges.join(split, ["package_id", "src"], "left").select("package_id", (twice(F.col("src")) + F.coalesce("exit", F.lit(0))).alias("src"), twice(F.col("dst")).alias("dst"), F.lit(1).alias("value"))
    kept = split.select("package_id", F.explode(F.array(twice(F.col("src")), twice(F.col("src")) + 1)).alias("node"))
    core, taken = contracted(edges, kept, lambda a, b: F.lit(1), F.min)
    key = ["package_id", "node", "variable", "definition"]
    half = lambda c: F.shiftright(c, 1).alias(c)
    step = core.select("package_id", F.shiftright("src", 1).alias("node"), half("dst"))
    # what leaves a node: its own definitions, and those that reach it of variables that it does not define
    leaving = own.select("package_id", "node", "variable", F.col("node").alias("definition"))
    known = leaving.where("false").select(*key)
    while not leaving.isEmpty():
        found = leaving.join(step, ["package_id", "node"]).select("package_id", F.col("dst").alias("node"), "variable", "definition").distinct()
        new = written(found.join(known, key, "left_anti"))
        known = written(known.unionByName(new))
        leaving = written(new.join(own, ["package_id", "node", "variable"], "left_anti"))
    out = known.join(own, ["package_id", "node", "variable"], "left_anti").unionByName(own.select("package_id", "node", "variable", F.col("node").alias("definition")))
    for into in reversed(taken):
        found = written(out.join(into.select("package_id", F.shiftright("src", 1).alias("node"), half("dst")), ["package_id", "node"]).select("package_id", F.col("dst").alias("node"), "variable", "definition").distinct())
        known, out = known.unionByName(found), out.unionByName(found)
    return known.select(*key)


def reaching_definitions(edges: DataFrame, definitions: DataFrame, small: int = SMALL) -> DataFrame:
    """package_id, node, variable, definition: the definitions (package_id, node, variable string) that reach the entry of each node over edges (package_id, src, dst). Rows with nulls are left out, repeated ones count once."""
    rows = edges.select("package_id", F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.lit(None).cast("string").alias("variable")).where("b is not null")
    rows = rows.unionByName(definitions.select("package_id", F.col("node").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "variable").where("variable is not null"))
    rows = written(rows.where("package_id is not null and a is not null").distinct())
    d = F.count_if(F.col("b").isNull())
    size = rows.groupBy("package_id").agg(F.count("*").alias("n"), d.alias("d"))
    big = written(size.where((F.col("n") > small) | (F.col("n") * F.col("d") > BITS)).select("package_id"))
    few = dealt(rows.join(big, "package_id", "left_anti")).mapInArrow(_solve, _OUT)
    if big.isEmpty():
        return few
    rows = written(rows.join(big, "package_id", "left_semi"))
    large = _large(rows.where("b is not null").select("package_id", F.col("a").alias("src"), F.col("b").alias("dst")), rows.where("b is null").select("package_id", F.col("a").alias("node"), "variable"))
    return few.unionByName(large)
