"""Packages as a whole: entry files, dependencies between files, analysis of a corpus, results as text."""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from json import dumps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..operators.closure import SMALL, checkpointed, reach, reached, written
from ..operators.components import strong_components
from ..operators.witness import shortest_paths
from . import detect, param_types, protocol
from .flow import flow_of

#: Where an entry file is looked for after package.json, in order.
ENTRIES = ("index.js", "lib/index.js", "src/index.js", "dist/index.js")
_NUMBER = re.compile(r"[0-9]+").fullmatch
_REQUIRE = r"""(?:\brequire\s*\(\s*|\bfrom\s+|\bimport\s+)(['"])(\.{1,2}/[^'"\n]+|\.{1,2})\1"""


@dataclass
class Timers:
    """Milliseconds of each stage, in the order of their ends."""

    taken: list[tuple[str, float]] = field(default_factory=list)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.taken.append((name, (time.perf_counter() - began) * 1000))

    def table(self, spark: SparkSession) -> DataFrame:
        """stage, ms"""
        return spark.createDataFrame(self.taken, "stage string, ms double")


def normal(path: Column) -> Column:
    """A path without . and .. steps."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    steps = F.aggregate(parts, empty, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    return F.array_join(steps, "/")


def _found(wanted: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """wanted (key, package_id, candidate, rank): the first candidate that is a file, as it is, with .js or as a folder."""
    shapes = F.array(F.col("candidate"), F.concat("candidate", F.lit(".js")), F.concat("candidate", F.lit("/index.js")))
    rows = wanted.select(*key, "rank", F.posexplode(shapes).alias("shape", "path"))
    rows = rows.withColumn("path", F.regexp_replace("path", "^/", "")).join(files.select("package_id", "path").distinct(), ["package_id", "path"])
    first = Window.partitionBy(*key).orderBy("rank", "shape")
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(*key, "path")


def entry_files(files: DataFrame) -> DataFrame:
    """package_id, path: each package's entry, by main in package.json or the usual places. files: (package_id, path, content), paths relative to the package."""
    main = files.where("path = 'package.json'").select("package_id", normal(F.get_json_object("content", "$.main")).alias("candidate"), F.lit(0).alias("rank")).where("candidate is not null")
    usual = files.select("package_id").distinct().select("package_id", F.posexplode(F.array(*map(F.lit, ENTRIES))).alias("rank", "candidate"))
    wanted = main.unionByName(usual.select("package_id", "candidate", (F.col("rank") + 1).alias("rank")))
    return _found(wanted, files, ["package_id"])


def script_files(files: DataFrame) -> DataFrame:
    """package_id, nth (from 1), path: the scripts of each package in the order of their paths."""
    scripts = files.where(F.col("path").endswith(".js")).select("package_id", "path").distinct()
    return scripts.select("package_id", F.row_number().over(Window.partitionBy("package_id").orderBy("path")).alias("nth"), "path")


def file_dependencies(files: DataFrame) -> DataFrame:
    """package_id, path, dependency: files that a file requires or imports by a relative name."""
    scripts = files.where(F.col("path").endswith(".js"))
    names = scripts.select("package_id", F.col("path").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_REQUIRE), F.lit(2)))).alias("name"))
    folder = F.regexp_replace("source", r"[^/]*$", "")
    wanted = names.select("package_id", "source", normal(F.concat(folder, "name")).alias("candidate"), F.lit(0).alias("rank"))
    wanted = wanted.withColumn("name", F.col("candidate"))
    found = _found(wanted, files, ["package_id", "source", "name"])
    return found.select("package_id", F.col("source").alias("path"), F.col("path").alias("dependency")).distinct()


def dependency_closure(files: DataFrame, roots: DataFrame) -> DataFrame:
    """package_id, path: roots (package_id, path) and all files that they need."""
    ids = files.select("package_id", "path", F.xxhash64("path").alias("node"))
    edges = file_dependencies(files).select("package_id", F.xxhash64("path").alias("src"), F.xxhash64("dependency").alias("dst"))
    seeds = roots.select("package_id", F.lit(0).cast("long").alias("origin"), F.xxhash64("path").alias("node"))
    return ids.join(reach(edges, seeds, min_hops=0).select("package_id", "node"), ["package_id", "node"]).select("package_id", "path")


def dependency_levels(files: DataFrame, small: int = SMALL) -> DataFrame:
    """package_id, path, component, level: scripts that need each other in a circle are one component, named by its first path; what a file needs comes before it in the order of levels."""
    scripts = files.where(F.col("path").endswith(".js")).select("package_id", "path").distinct()
    node = lambda c: F.xxhash64(c)
    edges = file_dependencies(files).select("package_id", node("path").alias("src"), node("dependency").alias("dst"))
    ids = scripts.select("package_id", "path", node("path").alias("node"))
    found = strong_components(edges, ids, small).join(ids, ["package_id", "node"])
    first = found.groupBy("package_id", "component").agg(F.min("path").alias("first"))
    return found.join(first, ["package_id", "component"]).select("package_id", "path", F.col("first").alias("component"), "level")


def dependency_paths(files: DataFrame, roots: DataFrame, small: int = SMALL) -> DataFrame:
    """package_id, path, way: for each file that the roots (package_id, path) need, the files on a shortest way from a root to it, without the root; of equally long ways the first by the names on it."""
    needs = file_dependencies(files)
    names = needs.select("package_id", F.col("path").alias("name")).unionByName(needs.select("package_id", F.col("dependency").alias("name"))).unionByName(roots.select("package_id", F.col("path").alias("name"))).distinct()
    ids = written(names.withColumn("node", F.row_number().over(Window.partitionBy("package_id").orderBy("name")).cast("long")))
    of = lambda df, c, to: df.join(ids.select("package_id", F.col("name").alias(c), F.col("node").alias(to)), ["package_id", c])
    # an edge has the number of the file that it leads to, so that ways are compared by the names on them
    edges = of(of(needs, "path", "src"), "dependency", "dst").select("package_id", F.col("dst").alias("edge_id"), "src", "dst")
    seeds = written(of(roots, "path", "node").select("package_id", F.lit(0).cast("long").alias("origin"), "node").distinct())
    found = shortest_paths(edges, seeds, ids.withColumn("origin", F.lit(0).cast("long")), small)
    steps = found.select("package_id", F.col("node").alias("goal"), F.posexplode("path").alias("at", "node"))
    steps = steps.join(ids, ["package_id", "node"]).groupBy("package_id", "goal").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("steps"))
    rows = found.join(steps.withColumnRenamed("goal", "node"), ["package_id", "node"], "left").join(ids, ["package_id", "node"])
    way = F.coalesce(F.transform("steps", lambda s: s["name"]), F.array().cast("array<string>"))
    return rows.select("package_id", F.col("name").alias("path"), way.alias("way"))


def dependency_text(files: DataFrame) -> DataFrame:
    """package_id, line: each file and what it needs."""
    rows = file_dependencies(files).groupBy("package_id", "path").agg(F.array_sort(F.collect_set("dependency")).alias("needs"))
    return rows.select("package_id", F.concat("path", F.lit(": "), F.array_join("needs", ", ")).alias("line"))


#: Types of what prototype pollution passes, and of what may be a string.
POLLUTING, TEXT = '{"_union":["polluted_object2","polluted_object3"]}', '{"_union":["object",["string","string"],"string"]}'


#: Keys of an array that are further apart are not filled one by one.
GAP = 64


def _union(*parts: str) -> str:
    return '{"_union":[' + ",".join(parts) + "]}"


def _array(children: list[tuple[str, str]]) -> str:
    """Numeric keys as an array: each value at its index, "any" between; a gap of over GAP is one item {"_any": its length}; an only any is "array"."""
    items, last = [], -1
    for at, json in sorted((int(name), json) for name, json in children if _NUMBER(name)):
        gap = at - last - 1
        items += [f'{{"_any":{gap}}}'] if gap > GAP else ['"any"'] * gap
        items.append(json)
        last = at
    return '"array"' if items == ['"any"'] else "[" + ",".join(items) + "]"


def _folded_node(children: list[tuple[str, str]], role: str | None, for_pollution: bool, methods: frozenset[str]) -> str:
    """The JSON of a node from its properties (name, JSON), by name."""
    names = {name for name, _ in children}
    whole = "{" + ",".join(f"{dumps(name, ensure_ascii=False)}:{json}" for name, json in children) + "}"
    if not for_pollution:
        return _union(whole, '"string"', '"array"') if "length" in names else whole
    loose = bool(names & {"*", "length"})
    indexed = {n for n in names if _NUMBER(n)}
    rest = names - indexed - {"*", "length"}
    if loose and role == "object":
        return '"object"'
    if loose and role == "value":
        return POLLUTING
    if indexed:
        return _union(whole, _array(children)) if rest else _array(children)
    if "length" in names and rest <= methods:
        return TEXT
    return '{"_union":["object","array"]}' if loose else whole


def _folded(rows: list[tuple[list[str], str]], role: str | None, for_pollution: bool, methods: frozenset[str]) -> str:
    """The JSON of a parameter from its prefixes and their own types; role holds at the root."""
    below: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    json = '"any"'
    for prefix, own in sorted(((tuple(p), j) for p, j in rows), key=lambda r: (-len(r[0]), r)):
        children = below.pop(prefix, None)
        json = own if children is None else _folded_node(sorted(children), None if prefix else role, for_pollution, methods)
        if prefix:
            below.setdefault(prefix[:-1], []).append((prefix[-1], json))
    return '"object"' if for_pollution and role == "object" and json == '"any"' else json


def folded_parameters(types: DataFrame, string_methods: tuple[str, ...] = (), polluted: DataFrame | None = None) -> DataFrame:
    """package_id, fn, param, param_index, json from inferred types (package_id, fn, param, prefix, param_index, types).

    Trees are folded from their leaves, a parameter at a time: its JSON is one value of one row anyway. polluted
    (package_id, fn, param, role in 'object', 'value'): for prototype pollution, the polluted object and the polluting
    values; without it a node with length may be a string or array too.
    """
    key, methods, for_pollution = ["package_id", "fn", "param"], frozenset(string_methods), polluted is not None
    root = F.when(F.size("prefix") == 0, F.col("param_index"))
    rows = types.groupBy(*key).agg(F.max(root).alias("param_index"), F.collect_list(F.struct("prefix", param_types.folded(F.col("types")).alias("json"))).alias("nodes"))
    if polluted is not None:
        rows = rows.join(polluted.groupBy(*key).agg(F.min("role").alias("role")), key, "left")
    else:
        rows = rows.withColumn("role", F.lit(None).cast("string"))

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, roles = batch.column("nodes").to_pylist(), batch.column("role").to_pylist()
            texts = [_folded([(n["prefix"], n["json"]) for n in nodes], role, for_pollution, methods) for nodes, role in zip(lists, roles, strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in (*key, "param_index")), pa.array(texts, pa.string())], names=[*key, "param_index", "json"])

    return rows.mapInArrow(fold, "package_id string, fn long, param string, param_index int, json string")


def parameter_json(types: DataFrame, string_methods: tuple[str, ...] = (), polluted: DataFrame | None = None) -> DataFrame:
    """package_id, fn, tainted_params, params_types: the parameters of each function, in order, and their types as one JSON object (see folded_parameters)."""
    ordered = F.array_sort(F.collect_list(F.struct("param_index", "param", "json")))
    folded = folded_parameters(types, string_methods, polluted).groupBy("package_id", "fn").agg(ordered.alias("params"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("params", lambda p: F.concat(F.lit('"'), p["param"], F.lit('":'), p["json"])), ","), F.lit("}"))
    return folded.select("package_id", "fn", F.transform("params", lambda p: p["param"]).alias("tainted_params"), text.alias("params_types"))


def taint_summaries(graph: PropertyGraph, found: DataFrame, config: dict[str, DataFrame], sources: DataFrame | None = None) -> DataFrame:
    """Detections with the way to reach them: type, source, tainted_params, params_types, and the nested returns, in the column summary as JSON."""
    owner = protocol.parent_functions(graph).withColumnRenamed("statement", "sink_function")
    hits = checkpointed(found.join(owner, ["package_id", "sink_function"]))
    servers = None if sources is None else protocol.server_ports(sources)
    targets = lambda df: df.select("package_id", F.col("func").alias("target")).distinct()
    if servers is None:
        calls = protocol.call_paths(graph, targets(hits))
    else:  # only files' contents are reached by a request
        traversal = F.coalesce(F.col("vuln_type") == "path-traversal", F.lit(False))
        calls = protocol.call_paths(graph, targets(hits.where(~traversal))).unionByName(protocol.call_paths(graph, targets(hits.where(traversal)), servers=servers))
    ways = checkpointed(protocol.summaries(calls).withColumnRenamed("target", "func").distinct())
    functions = ways.select("package_id", F.explode("path").alias("c")).select("package_id", F.col("c.fn_id").alias("fn")).where("fn is not null").distinct()
    trees = checkpointed(param_types.parameter_trees(graph, functions))
    types = param_types.inferred(graph, trees, config["sinks"], config["signatures"], config["prototypes"])
    args = parameter_json(types).select("package_id", F.col("fn").alias("fn_id"), "tainted_params", "params_types")
    step = ways.select("package_id", "func", "type", "source", F.col("path").alias("whole"), F.posexplode(F.arrays_zip("path", "calls")).alias("at", "z")).select("package_id", "func", "type", "source", "whole", "at", F.col("z.calls").alias("call"), F.col("z.path.fn_id").alias("fn_id"), F.col("z.path.port").alias("port"))
    step = step.join(args, ["package_id", "fn_id"], "left")
    one = F.struct(F.col("at"), F.col("call").alias("source"), F.coalesce("tainted_params", F.array().cast("array<string>")).alias("tainted_params"), F.coalesce("params_types", F.lit("{}")).alias("params_types"), F.col("port"))
    way = step.groupBy("package_id", "func", "type", "source", "whole").agg(F.array_sort(F.collect_list(one)).alias("steps"))

    def text(s: Column) -> Column:
        return F.concat(F.lit('"source":'), F.to_json(F.array(s["source"])).substr(F.lit(2), F.length(F.to_json(F.array(s["source"]))) - 2), F.lit(',"tainted_params":'), F.to_json(s["tainted_params"]), F.lit(',"params_types":'), s["params_types"])

    inner = F.aggregate(F.reverse(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0)))), F.lit(""), lambda acc, s: F.concat(F.lit(',"returns":{'), text(s), acc, F.lit("}")))
    way = way.withColumn("protocol", F.concat(text(F.col("steps")[0]), inner)).withColumn("port", F.col("steps")[0]["port"])
    rows = hits.join(way, ["package_id", "func"])
    q = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)), F.lit("null"))
    head = F.concat(F.lit('{"type":'), q("type"), F.lit(',"filename":'), q("filename"), F.lit(',"vuln_type":'), q("vuln_type"), F.lit(',"sink":'), q("sink"), F.lit(',"sink_lineno":'), F.coalesce(F.col("sink_lineno").cast("string"), F.lit("null")), F.lit(","), F.col("protocol"))
    client = F.when(F.col("port").isNotNull(), F.concat(F.lit(',"client":{"type":"GET","port":'), F.col("port").cast("string"), F.lit("}"))).otherwise("")
    return rows.select(*detect.DETECTIONS, "type", "source", F.concat(head, client, F.lit("}")).alias("summary")).distinct()


def analyse(graph: PropertyGraph, config: dict[str, DataFrame], lines: DataFrame | None = None, sources: DataFrame | None = None, query: str = "bottom_up", with_types: bool = False, timers: Timers | None = None) -> DataFrame:
    """The detections of a corpus; with_types: and how to reach each. With timers every stage is written and timed."""
    timers, keep = timers or Timers(), checkpointed if timers else lambda df: df
    with timers.stage("call_graph"):
        flow = None if query == "intra" else flow_of(graph)
    with timers.stage("injection_detection"):
        injected = keep(detect.injections(graph, config["sinks"], lines, query, flow))
    with timers.stage("proto_pollution_detection"):
        polluted = keep(detect.pollutions(graph, lines, query, flow))
    found = injected.unionByName(polluted).distinct()
    if not with_types:
        return found
    with timers.stage("reconstruction"):
        return keep(taint_summaries(graph, found, config, sources))


def drawing(graph: PropertyGraph, ignore: tuple[str, ...] = ()) -> DataFrame:
    """package_id, part, line: DOT text of each package's graph without edges of the rel_types in ignore; lines in the order of part, line."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit("'")), F.lit('"'))
    packages = graph.nodes.select("package_id").distinct()
    head = packages.select("package_id", F.lit(0).alias("part"), F.lit("digraph {").alias("line"))
    nodes = graph.nodes.select("package_id", F.lit(1).alias("part"), F.concat(F.lit("  "), F.col("node_id").cast("string"), F.lit(" [label="), quoted(F.concat_ws(" ", F.col("node_id").cast("string"), "type", "identifier_name")), F.lit("];")).alias("line"))
    drawn = graph.edges.where(~F.col("rel_type").isin(*ignore)) if ignore else graph.edges
    edges = drawn.select("package_id", F.lit(2).alias("part"), F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string"), F.lit(" [label="), quoted(F.concat_ws(":", "rel_type", "relation_type", "identifier_name")), F.lit("];")).alias("line"))
    return head.unionByName(nodes).unionByName(edges).unionByName(packages.select("package_id", F.lit(3).alias("part"), F.lit("}").alias("line")))


# fixed values: colours of edges by rel_type, of nodes by what their type starts with, and the edges drawn dashed
EDGE_COLOURS = {"AST": "blue", "CFG": "red", "SUB": "darkgreen", "PDG": "darkgreen", "CG": "goldenrod3"}
NODE_COLOURS = {"CFG": "red", "PDG": "darkgreen", "TAINT": "goldenrod4"}
DASHED = ("REF", "SINK")


def drawing_from(graph: PropertyGraph, starts: DataFrame, ignore: tuple[str, ...] = (), ignore_functions: tuple[str, ...] = (), exported: DataFrame | None = None) -> DataFrame:
    """package_id, part, line: DOT text, in colours, of what starts (package_id, node) lead to.

    Edges of a rel_type in ignore are not followed, nodes of a type in ignore or with a name in ignore_functions neither drawn
    nor entered. exported (package_id, node) are marked. A package in which nothing is drawn has no lines.
    """
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit("'")), F.lit('"'))
    chosen = lambda c, of, other: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in of.items()), F.lit(other))
    within = lambda c, names: F.coalesce(F.col(c).isin(*names), F.lit(False)) if names else F.lit(False)
    free = graph.nodes.where(~within("type", ignore) & ~within("identifier_name", ignore_functions))
    own = checkpointed(free.select("package_id", F.col("node_id").alias("node"), "type", "identifier_name"))
    ids = own.select("package_id", "node")
    end = lambda c: ids.withColumnRenamed("node", c)
    edges = graph.edges.where(~within("rel_type", ignore)).join(end("src"), ["package_id", "src"], "left_semi").join(end("dst"), ["package_id", "dst"], "left_semi")
    seeds = starts.select("package_id", "node").distinct().join(ids, ["package_id", "node"], "left_semi")
    drawn = checkpointed(reached(edges, seeds, min_hops=0).distinct())
    marked = (drawn.where("false") if exported is None else exported).select("package_id", "node", F.lit(True).alias("exported")).distinct()
    node = own.join(drawn, ["package_id", "node"]).join(marked, ["package_id", "node"], "left")
    colour = F.when(F.col("exported"), F.lit("darkviolet")).otherwise(chosen(F.substring_index("type", "_", 1), NODE_COLOURS, "blue"))
    nodes = node.select("package_id", F.lit(1).alias("part"), F.concat(F.lit("  "), F.col("node").cast("string"), F.lit(" [label="), quoted(F.concat_ws(" ", F.col("node").cast("string"), "type", "identifier_name")), F.lit(" color="), colour, F.lit(" fontcolor="), colour, F.lit("];")).alias("line"))
    shade = chosen(F.col("rel_type"), EDGE_COLOURS, "black")
    style = F.when(within("rel_type", DASHED), F.lit("dashed")).otherwise("solid")
    arrows = edges.join(drawn.withColumnRenamed("node", "src"), ["package_id", "src"], "left_semi")
    arrows = arrows.select("package_id", F.lit(2).alias("part"), F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string"), F.lit(" [label="), quoted(F.concat_ws(":", "rel_type", "relation_type", "identifier_name")), F.lit(" color="), shade, F.lit(" fontcolor="), shade, F.lit(" style="), style, F.lit("];")).alias("line"))
    packages = drawn.select("package_id").distinct()
    return packages.select("package_id", F.lit(0).alias("part"), F.lit("digraph {").alias("line")).unionByName(nodes).unionByName(arrows).unionByName(packages.select("package_id", F.lit(3).alias("part"), F.lit("}").alias("line")))
