"""Definitions of variables in program graphs, how far they reach, and in which order functions can be worked on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..operators.closure import SMALL
from ..operators.components import strong_components
from ..operators.dataflow import reaching_definitions
from ..operators.match import hop, label, start, union
from ..operators.regular import many, matches, seq, step
from .flow import FUNCTION, call_graph


def definitions(graph: PropertyGraph) -> DataFrame:
    """package_id, node, variable: declarators in the control flow, and statements that assign to a name."""
    flow = graph.e("CFG")
    inside = union(flow.select("package_id", F.col("src").alias("node")), flow.select("package_id", F.col("dst").alias("node")))
    declared = label(graph, inside, "node", FUNCTION, keep={"variable": "identifier_name"})
    assigned = label(graph, hop(graph, start(graph, "node", "ExpressionStatement"), "node", "assignment", "AST"), "assignment", "AssignmentExpression")
    assigned = label(graph, hop(graph, assigned, "assignment", "name", "AST", "left"), "name", "Identifier", keep={"variable": "identifier_name"})
    return union(declared, assigned.select("package_id", "node", "variable")).where("variable is not null")


def reaching(graph: PropertyGraph, small: int = SMALL) -> DataFrame:
    """package_id, node, variable, definition: what each statement may read, by the control flow with its branches and loops."""
    return reaching_definitions(graph.e("CFG"), definitions(graph), small)


def function_levels(graph: PropertyGraph, small: int = SMALL) -> DataFrame:
    """package_id, fn, component, level: functions that call each other in a circle are one component; callees come first in the order of levels."""
    functions = hop(graph, start(graph, "node", FUNCTION), "node", "body", "AST", "init", types=["FunctionExpression", "ArrowFunctionExpression"])
    calls = call_graph(graph).select("package_id", F.col("func").alias("src"), F.col("callee").alias("dst"))
    return strong_components(calls, functions.select("package_id", "node"), small).withColumnRenamed("node", "fn")


def sinks_of_parameters(graph: PropertyGraph, small: int = SMALL) -> DataFrame:
    """package_id, fn, statement: the statements with a sink that a parameter of fn leads to without entering calls."""
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    free = is_("rel_type", "PDG") & ~is_("relation_type", "ARG")
    pattern = seq(step(is_("rel_type", "REF") & is_("relation_type", "param")), many(step(free)), step(is_("rel_type", "SINK"), backward=True))
    seeds = start(graph, "origin", FUNCTION).withColumn("node", F.col("origin"))
    return matches(graph.edges, seeds, pattern, small).withColumnsRenamed({"origin": "fn", "node": "statement"})
