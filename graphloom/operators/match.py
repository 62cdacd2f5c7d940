"""Pattern matching as joins.

A pattern is a table of bindings: package_id and a column of node ids for each variable. ``hop``
adds a variable over an edge, ``label`` tests a node's type, ``exists`` and ``missing`` are the
semi and anti joins, ``optional`` the outer one. Filters go into the edge and node scans before the
join, so Catalyst pushes them to the files; which side is broadcast is left to it. Where the edge table has the
types of its ends (src_type, dst_type), a test of the types at a hop is a filter, not a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph


def start(graph: PropertyGraph, variable: str, *types: str, where: Column | None = None, keep: dict[str, str] | None = None) -> DataFrame:
    """Bindings of one variable; keep: node columns to carry, by new name."""
    nodes = graph.n(*types)
    nodes = nodes if where is None else nodes.where(where)
    return nodes.select("package_id", F.col("node_id").alias(variable), *(F.col(c).alias(k) for k, c in (keep or {}).items()))


def ends(graph: PropertyGraph, edges: DataFrame, src: Sequence[str] = (), dst: Sequence[str] = ()) -> DataFrame:
    """Edges (with package_id, src, dst) whose ends are nodes of some types; none: any."""
    for end, types in (("src", src), ("dst", dst)):
        if types:
            kind = f"{end}_type"
            edges = edges.where(F.col(kind).isin(*types)) if kind in edges.columns else label(graph, edges, end, *types)
    return edges


def _edges(graph: PropertyGraph, source: str, target: str, rel: str, relation: str | Sequence[str] | None, name: str | None, reverse: bool, keep: dict[str, str] | None, types: Sequence[str] = (), source_types: Sequence[str] = ()) -> DataFrame:
    edges = graph.e(rel, None if isinstance(relation, (list, tuple)) else relation, name)
    if isinstance(relation, (list, tuple)):
        edges = edges.where(F.col("relation_type").isin(*relation))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    edges = ends(graph, edges, *((types, source_types) if reverse else (source_types, types)))
    return edges.select("package_id", F.col(a).alias(source), F.col(b).alias(target), *(F.col(c).alias(k) for k, c in (keep or {}).items()))


def hop(graph: PropertyGraph, found: DataFrame, source: str, target: str, rel: str, relation: str | Sequence[str] | None = None, name: str | None = None, reverse: bool = False, keep: dict[str, str] | None = None, types: Sequence[str] = (), source_types: Sequence[str] = ()) -> DataFrame:
    """source -[rel]-> target. Where target is bound already, the edge must lead there. keep: edge columns to carry, by new name; types, source_types: of the target and of the source."""
    edges = _edges(graph, source, target, rel, relation, name, reverse, keep, types, source_types)
    return found.join(edges, ["package_id", source] + [target] * (target in found.columns))


def optional(graph: PropertyGraph, found: DataFrame, source: str, target: str, rel: str, relation: str | Sequence[str] | None = None, name: str | None = None, reverse: bool = False, types: Sequence[str] = (), keep: dict[str, str] | None = None) -> DataFrame:
    """As hop, but a binding without such an edge (to a node of types) stays with a null target."""
    return found.join(_edges(graph, source, target, rel, relation, name, reverse, keep, types), ["package_id", source], "left")


def label(graph: PropertyGraph, found: DataFrame, variable: str, *types: str, where: Column | None = None, keep: dict[str, str] | None = None) -> DataFrame:
    """Bindings whose variable is a node of types; keep: node columns to carry, by new name."""
    nodes = start(graph, variable, *types, where=where, keep=keep)
    return found.join(nodes, ["package_id", variable], "inner" if keep else "left_semi")


def exists(found: DataFrame, other: DataFrame, *variables: str) -> DataFrame:
    return found.join(other.select("package_id", *variables), ["package_id", *variables], "left_semi")


def missing(found: DataFrame, other: DataFrame, *variables: str) -> DataFrame:
    return found.join(other.select("package_id", *variables), ["package_id", *variables], "left_anti")


def union(*branches: DataFrame) -> DataFrame:
    """Rows of all branches, once each."""
    return reduce(DataFrame.unionByName, branches).distinct()


def first_match(branches: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """For each key the rows of the first branch that has any; none where the key has a null. Branches are evaluated once."""
    ranked = reduce(DataFrame.unionByName, [b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)])
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in key])
    best = F.min("branch").over(Window.partitionBy(*key))
    return ranked.where(known).withColumn("best", best).where("branch = best").drop("branch", "best")


def single(found: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the first by order: a fixed choice where any would do."""
    w = Window.partitionBy(*key).orderBy(*order)
    return found.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
