"""Call-graph preprocessing and confirmation of parameters, as fixpoints over the whole corpus.

Taint flows over every PDG edge, but into a call only through an argument edge known to be valid: one
to the receiver or to an unknown callee, or one whose parameter reaches a return. As that in turn needs
valid edges, both are computed together as the least fixpoint, so order and recursion do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..operators.closure import checkpointed, reach, reached
from ..operators.match import exists, hop, label, start, union

FUNCTION, OBJECT, CALL = "VariableDeclarator", "PDG_OBJECT", "PDG_CALL"


def call_graph(graph: PropertyGraph) -> DataFrame:
    """package_id, func, call, callee: calls made in functions that are function expressions."""
    found = hop(graph, start(graph, "func", FUNCTION), "func", "call", "REF", "call")
    found = label(graph, label(graph, hop(graph, found, "call", "callee", "CG"), "call", CALL), "callee", FUNCTION)
    body = label(graph, hop(graph, start(graph, "func", FUNCTION), "func", "body", "AST"), "body", "FunctionExpression")
    return exists(found, body, "func").distinct()


def callees_by_caller(graph: PropertyGraph) -> DataFrame:
    """package_id, func, calls: each caller's calls and callees."""
    return call_graph(graph).groupBy("package_id", "func").agg(F.array_sort(F.collect_set(F.struct("call", "callee"))).alias("calls"))


def callers_by_callee(graph: PropertyGraph) -> DataFrame:
    """package_id, callee, callers."""
    return call_graph(graph).groupBy("package_id", "callee").agg(F.array_sort(F.collect_set("func")).alias("callers"))


def exported_params(graph: PropertyGraph) -> DataFrame:
    """package_id, node: objects that the taint source leads to."""
    found = hop(graph, start(graph, "source", "TAINT_SOURCE"), "source", "node", "PDG", "TAINT")
    return label(graph, found, "node", OBJECT).select("package_id", "node").distinct()


def valid_seed(graph: PropertyGraph) -> DataFrame:
    """package_id, edge_id, src, dst: argument edges bound to the receiver or to an unknown callee."""
    edges = graph.e("PDG").where(F.col("identifier_name").isin("this", "undefined")).select("package_id", "edge_id", F.col("src").alias("arg"), F.col("dst").alias("call"))
    found = label(graph, label(graph, edges, "arg", OBJECT), "call", CALL)
    return found.select("package_id", "edge_id", F.col("arg").alias("src"), F.col("call").alias("dst"))


def _argument_edges(graph: PropertyGraph) -> DataFrame:
    """package_id, edge_id, arg, call, func, param: argument edges named after a parameter object of the called function."""
    edges = graph.e("PDG").select("package_id", "edge_id", F.col("src").alias("arg"), F.col("dst").alias("call"), F.col("identifier_name").alias("name"))
    found = hop(graph, label(graph, label(graph, edges, "arg", OBJECT), "call", CALL), "call", "func", "CG")
    found = hop(graph, label(graph, found, "func", FUNCTION), "func", "param", "REF")
    objects = graph.n(OBJECT).select("package_id", F.col("node_id").alias("param"), F.col("identifier_name").alias("name"))
    return found.join(objects, ["package_id", "param", "name"]).drop("name")


def parameter_edges(graph: PropertyGraph) -> DataFrame:
    """package_id, src, dst: from an argument to the parameter it becomes."""
    return _argument_edges(graph).select("package_id", F.col("arg").alias("src"), F.col("param").alias("dst"))


def valid_arguments(graph: PropertyGraph) -> DataFrame:
    """package_id, edge_id, src, dst of all argument edges that taint may pass: the seed, and those of parameters that reach a return over what may be passed."""
    calls = call_graph(graph)
    known = union(calls.select("package_id", "func"), calls.select("package_id", F.col("callee").alias("func")))
    candidate = checkpointed(exists(_argument_edges(graph), known, "func").select("package_id", "edge_id", F.col("arg").alias("src"), F.col("call").alias("dst"), "param").distinct())
    free = checkpointed(graph.e("PDG").where(~F.coalesce(F.col("relation_type") == "ARG", F.lit(False))).select("package_id", "src", "dst"))
    returns = start(graph, "node", "PDG_RETURN")
    valid = checkpointed(valid_seed(graph))
    n = valid.count()
    while True:
        back = reached(free.unionByName(valid.select("package_id", "src", "dst")), returns, backward=True, few=graph.few)
        more = candidate.join(back.withColumnRenamed("node", "param"), ["package_id", "param"], "left_semi").drop("param")
        valid = checkpointed(union(valid, more))
        if (now := valid.count()) == n:
            return valid
        n = now


@dataclass
class Flow:
    """What the queries on a graph share: edges that taint passes, and parameters an attacker controls."""

    edges: DataFrame
    exported: DataFrame
    confirmed: DataFrame


def confirmation_steps(graph: PropertyGraph, flow_edges: DataFrame) -> DataFrame:
    """package_id, src, dst: the caller's parameter src reaches, by flow but for the last hop, a call that passes something to the parameter dst."""
    named = graph.e("PDG").select("package_id", F.col("dst").alias("call"), F.col("identifier_name").alias("name"))
    calls = call_graph(graph)
    within = label(graph, hop(graph, hop(graph, start(graph, "caller", FUNCTION), "caller", "call", "REF", "call"), "call", "called", "CG"), "called", FUNCTION)
    within = within.select("package_id", "caller", "call").distinct().join(named, ["package_id", "call"])
    objects = graph.n(OBJECT).select("package_id", F.col("node_id").alias("param"), F.col("identifier_name").alias("name"))
    owner = hop(graph, start(graph, "func", FUNCTION), "func", "param", "REF").select("package_id", "func", "param")
    to = within.join(objects, ["package_id", "name"]).join(owner, ["package_id", "param"])
    to = exists(to, calls.select("package_id", F.col("func").alias("caller"), F.col("callee").alias("func")), "caller", "func").select("package_id", "caller", "call", "param").distinct()
    last = graph.e("PDG").select("package_id", F.col("dst").alias("origin"), F.col("src").alias("node"))
    seeds = last.join(to.select("package_id", F.col("call").alias("origin")).distinct(), ["package_id", "origin"], "left_semi")
    back = reach(flow_edges, seeds, min_hops=0, backward=True, few=graph.few).select("package_id", F.col("origin").alias("call"), F.col("node").alias("own"))
    own = label(graph, hop(graph, start(graph, "caller", FUNCTION), "caller", "own", "REF"), "own", OBJECT).distinct()
    return to.join(back, ["package_id", "call"]).join(own, ["package_id", "caller", "own"]).select("package_id", F.col("own").alias("src"), F.col("param").alias("dst")).distinct()


def passable(graph: PropertyGraph) -> DataFrame:
    """package_id, src, dst: dependencies that taint passes."""
    free = graph.e("PDG").where(~F.coalesce(F.col("relation_type") == "ARG", F.lit(False))).select("package_id", "src", "dst")
    return checkpointed(free.unionByName(valid_arguments(graph).select("package_id", "src", "dst")).distinct())


def flow_of(graph: PropertyGraph) -> Flow:
    edges = passable(graph)
    exported = checkpointed(exported_params(graph))
    confirmed = checkpointed(reached(confirmation_steps(graph, edges), exported, min_hops=0))
    return Flow(edges, exported, confirmed)


def declared_params(graph: PropertyGraph) -> DataFrame:
    """package_id, func, node: parameters of function declarators."""
    return label(graph, hop(graph, start(graph, "func", FUNCTION), "func", "node", "REF", "param"), "node", OBJECT).distinct()
