"""Detections: injection and prototype pollution, within a function (intra) or over calls (bottom_up)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..operators.closure import checkpointed, reach, reached
from ..operators.match import exists, hop, label, optional, single, start, union
from ..operators.witness import shortest_paths
from .flow import OBJECT, Flow, declared_params, flow_of, parameter_edges

DETECTIONS = ("package_id", "filename", "vuln_type", "sink", "sink_lineno", "sink_function")
_TAINT = ("SO", "ARG", "DEP")


def _sink_places(graph: PropertyGraph, sinks: DataFrame) -> DataFrame:
    """Statements of sinks (package_id, sink) and the syntax nodes with their locations."""
    found = hop(graph, sinks, "sink", "statement", "SINK", reverse=True)
    found = label(graph, found, "sink", keep={"sink_name": "identifier_name"})
    return label(graph, hop(graph, found, "statement", "syntax", "AST"), "syntax", keep={"location": "location"})


def injection_intra(graph: PropertyGraph) -> DataFrame:
    """package_id, sink: sinks that a tainted parameter of some function with a body reaches over any dependencies."""
    params = label(graph, hop(graph, start(graph, "source", "TAINT_SOURCE"), "source", "node", "PDG", "TAINT"), "node", OBJECT)
    functions = hop(graph, hop(graph, params, "node", "func", "REF", "param", reverse=True), "func", "body", "AST")
    back = reached(graph.e("PDG").select("package_id", "src", "dst"), functions.select("package_id", "node").distinct(), few=graph.few)
    return label(graph, back.withColumnRenamed("node", "sink"), "sink", "TAINT_SINK")


def injection_bottom_up(graph: PropertyGraph, flow: Flow) -> DataFrame:
    """package_id, sink: sinks that a confirmed parameter reaches by flow."""
    params = exists(declared_params(graph), flow.confirmed, "node").select("package_id", "node").distinct()
    return label(graph, reached(flow.edges, params, few=graph.few).withColumnRenamed("node", "sink"), "sink", "TAINT_SINK")


def located(found: DataFrame, lines: DataFrame | None) -> DataFrame:
    """Bindings with location and statement as detections; lines: (package_id, path, lineno, line)."""
    rows = found.select("package_id", F.col("location.fname").alias("filename"), "vuln_type", F.col("location.start.line").alias("sink_lineno"), F.col("statement").alias("sink_function"))
    if lines is None:
        return rows.withColumn("sink", F.lit("")).select(*DETECTIONS).distinct()
    text = lines.select("package_id", F.col("path").alias("filename"), F.col("lineno").alias("sink_lineno"), F.ltrim("line").alias("sink"))
    return rows.join(text, ["package_id", "filename", "sink_lineno"], "left").withColumn("sink", F.coalesce("sink", F.lit(""))).select(*DETECTIONS).distinct()


def vulnerability_types(sinks: DataFrame) -> DataFrame:
    """sink_name, vuln_type: the first class of each sink in the order of the config (sinks: vuln_type, sink, ord)."""
    return sinks.groupBy(F.col("sink").alias("sink_name")).agg(F.min_by("vuln_type", "ord").alias("vuln_type"))


def injections(graph: PropertyGraph, sinks: DataFrame, lines: DataFrame | None = None, query: str = "bottom_up", flow: Flow | None = None) -> DataFrame:
    found = injection_intra(graph) if query == "intra" else injection_bottom_up(graph, flow or flow_of(graph))
    return located(_sink_places(graph, found).join(vulnerability_types(sinks), "sink_name", "left"), lines)


def injection_witnesses(graph: PropertyGraph, sinks: DataFrame, lines: DataFrame | None = None, flow: Flow | None = None) -> DataFrame:
    """Detections of injections (bottom_up), each sink with a shortest path of edge_ids from a parameter that an attacker controls, in the column path."""
    flow = flow or flow_of(graph)
    params = exists(declared_params(graph), flow.confirmed, "node").select("package_id", F.lit(0).cast("long").alias("origin"), "node").distinct()
    edges = graph.e("PDG").select("package_id", "edge_id", "src", "dst").join(flow.edges, ["package_id", "src", "dst"], "left_semi")
    goals = start(graph, "node", "TAINT_SINK").withColumn("origin", F.lit(0).cast("long"))
    ways = shortest_paths(edges, params, goals).select("package_id", F.col("node").alias("sink"), "path")
    places = _sink_places(graph, ways.select("package_id", "sink")).join(vulnerability_types(sinks), "sink_name", "left").join(ways, ["package_id", "sink"])
    rows = places.select("package_id", "statement", "vuln_type", "location", "sink", "path")
    found = located(rows, lines)
    key = ["package_id", "sink_function"]
    return found.join(rows.select("package_id", F.col("statement").alias("sink_function"), F.col("sink").alias("sink_node"), "path").distinct(), key)


# prototype pollution ---------------------------------------------------------------------------


def _object(graph: PropertyGraph, found: DataFrame, *variables: str) -> DataFrame:
    for v in variables:
        found = label(graph, found, v, OBJECT)
    return found


def _write(graph: PropertyGraph, found: DataFrame, source: str) -> DataFrame:
    """source -NV *-> version -SO *-> property."""
    found = hop(graph, found, source, "version", "PDG", "NV", "*")
    return _object(graph, hop(graph, found, "version", "property", "PDG", "SO", "*"), "version", "property")


def _depends(graph: PropertyGraph, found: DataFrame, target: str, source: str) -> DataFrame:
    return _object(graph, hop(graph, found, target, source, "PDG", "DEP", reverse=True), source)


def _lookup(graph: PropertyGraph, name: str | None = "*") -> DataFrame:
    return _object(graph, hop(graph, start(graph, "obj", OBJECT), "obj", "sub", "PDG", "SO", name), "sub")


def pollution_patterns_intra(graph: PropertyGraph) -> DataFrame:
    """package_id, obj, sub, version, property: a lookup by any name, then a write by any name, directly or over parameters."""
    sub = _lookup(graph)
    direct = _write(graph, sub, "sub")
    over = reach(parameter_edges(graph), sub.select("package_id", F.col("sub").alias("origin"), F.col("sub").alias("node")))
    passed = _object(graph, sub.join(over.withColumnsRenamed({"origin": "sub", "node": "param"}), ["package_id", "sub"]), "param")
    names = ("package_id", "obj", "sub", "version", "property")
    return union(direct.select(*names), _write(graph, passed, "param").select(*names))


def pollution_patterns(graph: PropertyGraph) -> DataFrame:
    """package_id, obj, property1, property2, value, property: four ways from a lookup to a write."""
    sub = checkpointed(_depends(graph, _lookup(graph), "sub", "property1"))
    over = reach(parameter_edges(graph), sub.select("package_id", F.col("sub").alias("origin"), F.col("sub").alias("node")).distinct())
    passed = _object(graph, sub.join(over.withColumnsRenamed({"origin": "sub", "node": "param"}), ["package_id", "sub"]), "param")
    either = _object(graph, hop(graph, sub, "sub", "choice", "PDG", "DEP"), "choice")
    # objects that a || makes
    logical = label(graph, hop(graph, start(graph, "statement", "ExpressionStatement"), "statement", "choice", "REF", "obj"), "choice", OBJECT)
    logical = label(graph, hop(graph, logical, "statement", "assignment", "AST", "expression"), "assignment", "AssignmentExpression")
    logical = label(graph, hop(graph, logical, "assignment", "right", "AST", "right"), "right", "LogicalExpression")
    loose = _lookup(graph, None).withColumn("property1", F.col("obj"))
    looked = ((sub, "sub"), (passed, "param"), (exists(either, logical, "choice"), "choice"), (loose, "sub"))
    # the four ways differ in where the write starts; what is written there is found once
    ways = union(*(found.select("package_id", "obj", "property1", F.col(source).alias("source")) for found, source in looked))
    written = _depends(graph, _write(graph, start(graph, "source"), "source"), "version", "property2")
    written = _depends(graph, written, "property", "value")
    return ways.join(written, ["package_id", "source"]).select("package_id", "obj", "property1", "property2", "value", "property").distinct()


def _assignment(graph: PropertyGraph, found: DataFrame) -> DataFrame:
    """With the first statement that refers to the property, and its location, if there is one."""
    found = optional(graph, found, "property", "statement", "REF", reverse=True)
    keys = [c for c in found.columns if c != "statement"]
    found = single(found, keys, ["statement"])
    places = graph.nodes.select("package_id", F.col("node_id").alias("statement"), "location")
    return found.join(places, ["package_id", "statement"], "left").withColumn("vuln_type", F.lit("prototype-pollution"))


def prototype_pollution_bottom_up(graph: PropertyGraph, flow: Flow) -> DataFrame:
    """Patterns whose two properties and value are all exported, or all reached from confirmed parameters."""
    found = checkpointed(pollution_patterns(graph))
    params = exists(declared_params(graph), flow.confirmed, "node").select("package_id", "node").distinct()
    tainted = checkpointed(reached(flow.edges, params, min_hops=0, few=graph.few))

    def all_in(nodes: DataFrame) -> DataFrame:
        rows = found
        for v in ("property1", "property2", "value"):
            rows = rows.join(nodes.select("package_id", F.col("node").alias(v)), ["package_id", v], "left_semi")
        return rows

    rows = union(all_in(flow.exported), all_in(tainted))
    return _assignment(graph, rows.select("package_id", "obj", "value", "property"))


def prototype_pollution_intra(graph: PropertyGraph) -> DataFrame:
    """Patterns with a tainted key, a tainted assignment and a tainted value, one row for each value."""
    found = pollution_patterns_intra(graph)
    passable = graph.e("PDG").where(F.col("relation_type").isin(*_TAINT)).select("package_id", "src", "dst")
    taint = graph.e("PDG", "TAINT").select("package_id", F.col("src").alias("source"), F.col("dst").alias("node"))
    any_source = label(graph, taint, "node", OBJECT).select("package_id", "node").distinct()
    of_source = label(graph, label(graph, taint, "source", "TAINT_SOURCE"), "node", OBJECT).select("package_id", "node").distinct()
    key, assigned = reached(passable, of_source, few=graph.few), reached(passable, any_source, few=graph.few)
    found = found.join(key.withColumnRenamed("node", "sub"), ["package_id", "sub"], "left_semi").join(assigned.withColumnRenamed("node", "version"), ["package_id", "version"], "left_semi")
    values = reach(passable, any_source.select("package_id", F.col("node").alias("origin"), "node"), min_hops=0, few=graph.few).select("package_id", F.col("origin").alias("value"), F.col("node").alias("dep"))
    found = hop(graph, found, "property", "dep", "PDG", "DEP", reverse=True).join(values, ["package_id", "dep"]).select("package_id", "obj", "value", "property").distinct()
    found = exists(found, graph.e("REF").select("package_id", F.col("dst").alias("value")), "value")
    return _assignment(graph, found)


def pollutions(graph: PropertyGraph, lines: DataFrame | None = None, query: str = "bottom_up", flow: Flow | None = None) -> DataFrame:
    found = prototype_pollution_intra(graph) if query == "intra" else prototype_pollution_bottom_up(graph, flow or flow_of(graph))
    return located(found, lines)


def detections(graph: PropertyGraph, sinks: DataFrame, lines: DataFrame | None = None, query: str = "bottom_up") -> DataFrame:
    """All detections of a corpus: package_id, filename, vuln_type, sink, sink_lineno, sink_function."""
    flow = None if query == "intra" else flow_of(graph)
    return union(injections(graph, sinks, lines, query, flow), pollutions(graph, lines, query, flow))
