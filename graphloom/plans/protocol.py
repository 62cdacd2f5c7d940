"""Interaction protocol: how a caller of a package reaches the function of a sink, for all functions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..operators.closure import checkpointed, reach
from ..operators.match import exists, first_match, hop, label, optional, single, start, union
from .flow import CALL, FUNCTION, OBJECT

CALL_STEP = "struct<type:string,prop:string,fn_name:string,fn_id:bigint,source_fn_id:bigint,port:int>"


def walk(graph: PropertyGraph, edges: DataFrame, found: DataFrame, source: str, target: str, min_hops: int = 0, backward: bool = False) -> DataFrame:
    """source -*min_hops..-> target over some edges (package_id, src, dst) of the graph; the pairs are written, so that patterns with several walks do not repeat them."""
    seeds = found.select("package_id", F.col(source).alias("origin"), F.col(source).alias("node"))
    pairs = checkpointed(reach(edges, seeds.distinct(), min_hops, backward=backward, few=graph.few)).withColumnsRenamed({"origin": source, "node": target})
    return found.join(pairs, ["package_id", source])


def step(kind: str, prop: Column, fn_name: Column, fn_id: Column, source: Column) -> Column:
    parts = (F.lit(kind).alias("type"), prop.cast("string").alias("prop"), fn_name.alias("fn_name"), fn_id.alias("fn_id"), source.alias("source_fn_id"), F.lit(None).cast("int").alias("port"))
    return F.struct(*parts).cast(CALL_STEP)


def parent_functions(graph: PropertyGraph) -> DataFrame:
    """package_id, func, statement: each statement's function, by the context that its node carries (where absent, by control flow)."""
    return graph.once("parent_functions", lambda: _parent_functions(graph))


def _parent_functions(graph: PropertyGraph) -> DataFrame:
    owner = exists(hop(graph, start(graph, "func"), "func", "context", "FD"), hop(graph, start(graph, "func"), "func", "init", "AST", "init"), "func")
    own = graph.nodes.where("function_context is not null").select("package_id", F.col("node_id").alias("statement"), F.col("function_context").alias("context"))
    flow = graph.e("CFG").select("package_id", "src", "dst")
    lost = graph.nodes.where("function_context is null").select("package_id", F.col("node_id").alias("statement"))
    followed = exists(walk(graph, flow, owner, "context", "statement", 1), lost, "statement")
    return union(owner.join(own, ["package_id", "context"]).select("package_id", "func", "statement"), followed.select("package_id", "func", "statement"))


def function_files(graph: PropertyGraph) -> DataFrame:
    """package_id, fn, fname of functions bound to a declarator."""
    body = hop(graph, start(graph, "fn"), "fn", "body", "AST", "init")
    return label(graph, body, "body", "FunctionExpression", "ArrowFunctionExpression", keep={"location": "location"}).select("package_id", "fn", F.col("location.fname").alias("fname")).distinct()


def top_level(graph: PropertyGraph) -> DataFrame:
    """package_id, fn, path: functions called by their name in the main context, where they are declared."""
    main = start(graph, "context", "CFG_F_START", where=F.col("identifier_name") == "__main__")
    found = hop(graph, start(graph, "fn", keep={"fn_name": "identifier_name", "context": "function_context"}), "fn", "call", "CG", reverse=True)
    found = label(graph, exists(found, main, "context").drop("context"), "call", CALL, keep={"context": "function_context"})
    found = label(graph, hop(graph, exists(found, main, "context"), "call", "statement", "REF", "obj", reverse=True), "statement", FUNCTION)
    found = label(graph, hop(graph, found, "statement", "expression", "AST", "init"), "expression", "CallExpression")
    found = label(graph, hop(graph, found, "expression", "callee", "AST"), "callee", "Identifier", keep={"callee_name": "identifier_name"}).where("callee_name = fn_name")
    return found.select("package_id", "fn", F.array(step("TopLevel", F.lit(None), F.col("fn_name"), F.col("fn"), F.col("fn"))).alias("path"))


def properties(graph: PropertyGraph) -> DataFrame:
    """fn -REF obj-> fn_obj -DEP-> sub <-SO prop_name- obj."""
    return graph.once("properties", lambda: _properties(graph))


def _properties(graph: PropertyGraph) -> DataFrame:
    found = hop(graph, start(graph, "fn"), "fn", "fn_obj", "REF", "obj")
    found = hop(graph, label(graph, found, "fn_obj", OBJECT, keep={"fn_name": "identifier_name"}), "fn_obj", "sub", "PDG", "DEP")
    found = hop(graph, label(graph, found, "sub", OBJECT), "sub", "obj", "PDG", "SO", reverse=True, keep={"prop_name": "identifier_name"})
    return label(graph, found, "obj", OBJECT, keep={"obj_name": "identifier_name"})


def _exported(graph: PropertyGraph, found: DataFrame, source: str, holder: str) -> DataFrame:
    """source <-(PDG exports)- holder, an object named after module."""
    held = graph.once("exported", lambda: _holders(graph))
    return found.join(held.withColumnsRenamed({"source": source, "holder": holder}), ["package_id", source])


def _holders(graph: PropertyGraph) -> DataFrame:
    """package_id, source, holder, export_edge"""
    found = hop(graph, start(graph, "holder", OBJECT, where=F.col("identifier_name").contains("module")), "holder", "source", "PDG", None, "exports", keep={"export_edge": "edge_id"})
    return label(graph, found, "source", OBJECT)


def origins(graph: PropertyGraph, found: DataFrame) -> DataFrame:
    """package_id, obj, source, is_function: the syntax nodes that define each obj of found or an earlier object it comes from, and whether those are functions."""
    pdg = graph.e("PDG").select("package_id", "src", "dst")
    rows = label(graph, walk(graph, pdg, found.select("package_id", "obj").distinct(), "obj", "origin", backward=True), "origin", OBJECT)
    rows = hop(graph, rows, "origin", "source", "REF", "obj", reverse=True).select("package_id", "obj", "source").distinct()
    body = hop(graph, start(graph, "source"), "source", "context", "FD", types=["CFG_F_START"]).select("package_id", "source", F.lit(1).alias("is_function")).distinct()
    return rows.join(body, ["package_id", "source"], "left").withColumn("is_function", F.coalesce("is_function", F.lit(0)))


def _methods(found: DataFrame, exported_name: Column | None = None) -> DataFrame:
    """package_id, fn, path: a method of an exported object, or of what an exported constructor makes."""
    method = step("Method", F.col("prop_name"), F.col("fn_name"), F.col("fn"), F.col("fn"))
    new = step("New", F.lit(None) if exported_name is None else exported_name, F.col("obj_name"), F.col("source"), F.col("source"))
    return found.select("package_id", "fn", F.when(F.col("is_function") > 0, F.array(new, method)).otherwise(F.array(method)).alias("path"))


def exported_directly(graph: PropertyGraph) -> DataFrame:
    """module.exports = f, or a later version of its object."""
    nv = graph.e("PDG", "NV").select("package_id", "src", "dst")
    found = label(graph, hop(graph, start(graph, "fn"), "fn", "fn_obj", "REF", "obj"), "fn_obj", OBJECT, keep={"fn_name": "identifier_name"})
    older = walk(graph, nv, found, "fn_obj", "last", 1, backward=True)
    rest = found.join(older.select("package_id", "fn_obj").distinct(), ["package_id", "fn_obj"], "left_anti").withColumn("last", F.col("fn_obj"))
    found = label(graph, hop(graph, older.unionByName(rest), "last", "sub", "PDG", "DEP"), "sub", OBJECT)
    found = hop(graph, found, "sub", "holder", "PDG", "SO", "exports", reverse=True)
    found = label(graph, found, "holder", OBJECT, where=F.col("identifier_name").contains("module"))
    return found.select("package_id", "fn", F.array(step("Call", F.lit(None), F.col("fn_name"), F.col("fn"), F.col("fn"))).alias("path"))


def exported_by_exports(graph: PropertyGraph, found: DataFrame, origin: DataFrame) -> DataFrame:
    """exports.p = f."""
    return _methods(found.where(F.col("obj_name").contains("exports")).join(origin, ["package_id", "obj"]))


def exported_by_module(graph: PropertyGraph, found: DataFrame, origin: DataFrame) -> DataFrame:
    """module.exports = o with o.p = f, also one object deeper."""
    pdg, nv = (graph.e("PDG", k).select("package_id", "src", "dst") for k in (None, "NV"))
    loose = hop(graph, label(graph, walk(graph, pdg, found, "obj", "last"), "last", OBJECT), "last", "exports", "PDG", keep={"dep_edge": "edge_id"})
    loose = _exported(graph, loose, "exports", "holder").where("dep_edge <> export_edge")
    nested = hop(graph, label(graph, walk(graph, nv, found, "obj", "last"), "last", OBJECT), "last", "inner", "PDG", "DEP")
    nested = label(graph, hop(graph, label(graph, nested, "inner", OBJECT), "inner", "outer", "PDG", "SO", reverse=True), "outer", OBJECT)
    nested = hop(graph, walk(graph, nv, nested, "outer", "outer_last"), "outer_last", "exports", "PDG", "DEP")
    nested = exists(_exported(graph, nested, "exports", "holder"), graph.e("PDG", "SO", "exports").select("package_id", F.col("dst").alias("exports")), "exports")
    names = ("package_id", "fn", "fn_name", "prop_name", "obj", "obj_name")
    return _methods(union(loose.select(*names), nested.select(*names)).join(origin, ["package_id", "obj"]))


def exported_by_module_property(graph: PropertyGraph, found: DataFrame, origin: DataFrame) -> DataFrame:
    """module.exports.p = f, also one object deeper; module.exports = o, then o.p = f."""
    nv = graph.e("PDG", "NV").select("package_id", "src", "dst")
    names = ("package_id", "fn", "fn_name", "prop_name", "obj", "obj_name")
    plain = _exported(graph, hop(graph, found, "obj", "exports", "PDG", reverse=True), "exports", "holder")
    nested = label(graph, hop(graph, found, "obj", "inner", "PDG", "DEP"), "inner", OBJECT)
    nested = label(graph, hop(graph, nested, "inner", "outer", "PDG", "SO", reverse=True), "outer", OBJECT)
    nested = _exported(graph, walk(graph, nv, nested, "outer", "exports", 1, backward=True), "exports", "holder")
    later = hop(graph, label(graph, walk(graph, nv, found, "obj", "first", 1, backward=True), "first", OBJECT), "first", "exports", "PDG", "DEP")
    later = exists(_exported(graph, later, "exports", "holder"), graph.e("PDG", "SO", "exports").select("package_id", F.col("dst").alias("exports")), "exports")
    known = union(plain.select(*names), nested.select(*names)).join(origin, ["package_id", "obj"])
    later = later.select(*names).distinct().join(origin, ["package_id", "obj"]).withColumn("is_function", F.lit(0))
    return _methods(union(known.select(*names, "source", "is_function"), later.select(*names, "source", "is_function")))


def exported_by_prototype(graph: PropertyGraph, found: DataFrame, origin: DataFrame) -> DataFrame:
    """F.prototype.p = f with F exported, by itself or as a property."""
    nv = graph.e("PDG", "NV").select("package_id", "src", "dst")
    names = ("package_id", "fn", "fn_name", "prop_name", "obj", "obj_name", "export_name")

    def owner(rows: DataFrame) -> DataFrame:
        rows = label(graph, hop(graph, rows, "proto", "owner", "PDG", "SO", reverse=True), "owner", OBJECT)
        return label(graph, hop(graph, rows, "owner", "exports", "PDG", keep={"dep_edge": "edge_id"}), "exports", OBJECT)

    one = owner(hop(graph, found, "obj", "proto", "PDG", "NV", reverse=True))
    plain = _exported(graph, one, "exports", "holder").where("dep_edge <> export_edge").withColumn("export_name", F.lit(None).cast("string"))
    named = hop(graph, one, "exports", "slot", "PDG", "SO", reverse=True, keep={"export_name": "identifier_name"})
    named = _exported(graph, hop(graph, label(graph, named, "slot", OBJECT), "slot", "module_exports", "PDG", "NV", reverse=True), "module_exports", "holder")
    many = owner(walk(graph, nv, found, "obj", "proto", backward=True))
    bare = hop(graph, many, "exports", "slot", "PDG", "SO", reverse=True, keep={"export_name": "identifier_name"})
    bare = label(graph, walk(graph, nv, label(graph, bare, "slot", OBJECT), "slot", "exports_obj", backward=True), "exports_obj", OBJECT, where=F.col("identifier_name").contains("exports"))
    rows = union(plain.select(*names), named.select(*names), bare.select(*names)).join(origin.where("is_function > 0"), ["package_id", "obj"])
    return _methods(rows, F.col("export_name"))


def exported_by_this(graph: PropertyGraph, found: DataFrame, origin: DataFrame) -> DataFrame:
    """this.p = f in an exported constructor."""
    nv = graph.e("PDG", "NV").select("package_id", "src", "dst")
    found = walk(graph, nv, found.drop("obj_name"), "obj", "this_obj", 1, backward=True)
    this = graph.e("REF", "param").where("is_this").select("package_id", F.col("src").alias("source"), F.col("dst").alias("this_obj"))
    found = hop(graph, found.join(this, ["package_id", "this_obj"]), "source", "class_obj", "REF", "obj")
    found = hop(graph, label(graph, found, "class_obj", OBJECT, keep={"obj_name": "identifier_name"}), "class_obj", "exports", "PDG", keep={"dep_edge": "edge_id"})
    found = _exported(graph, found, "exports", "holder").where("dep_edge <> export_edge")
    return _methods(found.withColumn("is_function", F.lit(1)))


def exported_types(graph: PropertyGraph) -> DataFrame:
    """package_id, fn, path: how each exported function is reached from outside, by the first pattern that fits."""
    found = properties(graph)
    origin = checkpointed(origins(graph, found))
    branches = [exported_directly(graph)]
    for branch in (exported_by_exports, exported_by_module, exported_by_module_property, exported_by_prototype, exported_by_this):
        branches.append(branch(graph, found, origin))
    return single(first_match([b.distinct() for b in branches], ["package_id", "fn"]), ["package_id", "fn"], ["path"])


def returners(graph: PropertyGraph) -> DataFrame:
    """package_id, fn, source_fn, step: functions that return fn, or an object with it as a property."""
    ast = graph.e("AST").select("package_id", "src", "dst")

    def enclosing(found: DataFrame, returned: str) -> DataFrame:
        found = label(graph, hop(graph, found, returned, "ret", "PDG", "DEP"), "ret", "PDG_RETURN")
        found = hop(graph, found, "ret", "statement", "REF", reverse=True)
        found = label(graph, walk(graph, ast, found, "statement", "body", backward=True), "body", "FunctionExpression")
        return label(graph, hop(graph, found, "body", "source_fn", "AST", "init", reverse=True), "source_fn", FUNCTION)

    plain = label(graph, hop(graph, start(graph, "fn"), "fn", "obj", "REF", "obj"), "obj", OBJECT, keep={"obj_name": "identifier_name"})
    plain = enclosing(plain, "obj").select("package_id", "fn", "source_fn", step("Call", F.lit(None), F.col("obj_name"), F.col("fn"), F.col("source_fn")).alias("step"))
    prop = hop(graph, properties(graph), "obj", "parent", "PDG", "NV", reverse=True)
    prop = enclosing(label(graph, prop, "parent", OBJECT), "obj")
    pdg = graph.e("PDG").select("package_id", "src", "dst")
    defined = walk(graph, pdg, prop.select("package_id", "parent").distinct(), "parent", "origin", backward=True)
    defined = exists(defined, graph.e("REF", "obj").select("package_id", F.col("dst").alias("origin")), "origin")
    marked = hop(graph, start(graph, "source_fn"), "source_fn", "class_obj", "PDG", "DEP")
    nv = graph.e("PDG", "NV").select("package_id", "src", "dst")
    marked = exists(walk(graph, nv, marked, "class_obj", "version", 1), graph.e("PDG", "SO", "is_class").select("package_id", F.col("src").alias("version")), "version")
    marked = marked.select("package_id", "source_fn", F.lit(True).alias("is_class")).distinct()
    prop = exists(prop, defined, "parent").join(marked, ["package_id", "source_fn"], "left")
    parts = (F.col("prop_name"), F.col("fn_name"), F.col("fn"), F.col("source_fn"))
    prop = prop.select("package_id", "fn", "source_fn", F.when(F.col("is_class"), step("New", *parts)).otherwise(step("Method", *parts)).alias("step"))
    return union(plain, prop)


def _passed(graph: PropertyGraph) -> DataFrame:
    """package_id, fn, call, statement: functions passed to calls, and the statements that hold the results."""
    found = hop(graph, start(graph, "fn"), "fn", "fn_obj", "REF", "obj")
    found = hop(graph, label(graph, found, "fn_obj", OBJECT), "fn_obj", "call", "PDG", "ARG", types=[CALL])
    return hop(graph, found, "call", "statement", "REF", "obj", reverse=True)


def callbacks(graph: PropertyGraph) -> DataFrame:
    """package_id, fn, caller, kind: functions that a caller passes to a Promise, to then or, by name, to another call (callback)."""
    init = hop(graph, _passed(graph).select("package_id", "fn", "statement").distinct(), "statement", "expression", "AST", "init")
    called = label(graph, init, "expression", "CallExpression")
    promise = hop(graph, label(graph, init, "expression", "NewExpression"), "expression", "callee", "AST", "callee")
    promise = label(graph, promise, "callee", "Identifier", where=F.col("identifier_name") == "Promise")
    then = hop(graph, hop(graph, called, "expression", "callee", "AST", "callee", types=["MemberExpression"]), "callee", "property", "AST", "property")
    then = label(graph, then, "property", where=F.col("identifier_name") == "then")
    plain = label(graph, hop(graph, called, "expression", "arg", "AST", "arg"), "arg", "Identifier", keep={"name": "identifier_name"})
    plain = plain.join(start(graph, "fn", keep={"name": "identifier_name"}), ["package_id", "fn", "name"], "left_semi")
    kinds = [b.select("package_id", "fn", "statement", F.lit(kind).alias("kind")) for b, kind in ((promise, "promise"), (then, "then"), (plain, "callback"))]
    return union(*kinds).join(parent_functions(graph), ["package_id", "statement"]).select("package_id", "fn", F.col("func").alias("caller"), "kind").distinct()


def callers(graph: PropertyGraph) -> DataFrame:
    """package_id, fn, caller: functions whose statements call fn or pass it to a call (those of callbacks among them)."""
    statement = parent_functions(graph)
    direct = hop(graph, statement, "statement", "fn", "CG")
    made = hop(graph, hop(graph, label(graph, statement, "statement", FUNCTION), "statement", "call", "REF", "obj", types=[CALL]), "call", "fn", "CG")
    names = ("package_id", "fn", F.col("func").alias("caller"))
    return union(direct.select(*names), _passed(graph).join(statement, ["package_id", "statement"]).select(*names), made.select(*names))


#: How a server is recognised in a source text.
SERVER, LISTEN = r"\bcreateServer\b", r'\.listen\((\d+|"(\d+)")\)'


def server_ports(sources: DataFrame) -> DataFrame:
    """package_id, path, port of files that create a server and listen on a literal port."""
    port = F.replace(F.regexp_extract("content", LISTEN, 1), F.lit('"'), F.lit("")).try_cast("int")
    return sources.where(F.col("content").rlike(SERVER) & F.col("content").rlike(LISTEN)).select("package_id", "path", port.alias("port"))


def call_paths(graph: PropertyGraph, targets: DataFrame, main_files: DataFrame | None = None, servers: DataFrame | None = None) -> DataFrame:
    """package_id, target, path: for target functions (package_id, target) the calls, from outside to them, over callers and returners.

    main_files (package_id, fname): where paths may begin. servers (package_id, path, port): files whose functions begin with a request.
    Each function is entered once for a target, by the shortest way, however long.
    """
    begin = first_match([exported_types(graph), single(top_level(graph), ["package_id", "fn"], ["path"])], ["package_id", "fn"])
    files = function_files(graph)
    if servers is not None:
        request = F.array(F.struct(F.lit("ServerInitialization").alias("type"), F.lit(None).cast("string").alias("prop"), F.col("fname").alias("fn_name"), F.lit(None).cast("bigint").alias("fn_id"), F.lit(None).cast("bigint").alias("source_fn_id"), F.col("port")).cast(CALL_STEP))
        served = files.join(servers.withColumnRenamed("path", "fname"), ["package_id", "fname"]).select("package_id", "fn", request.alias("path"))
        begin = first_match([served, begin], ["package_id", "fn"])
    if main_files is not None:
        begin = exists(begin, files.join(main_files, ["package_id", "fname"]), "fn")
    begin = checkpointed(begin)
    up = checkpointed(union(callers(graph).where("fn <> caller").select("package_id", "fn", F.col("caller").alias("next"), F.lit(None).cast(CALL_STEP).alias("step")), returners(graph).select("package_id", "fn", F.col("source_fn").alias("next"), "step")))
    empty = F.array().cast(f"array<{CALL_STEP}>")
    state = checkpointed(targets.select("package_id", "target", F.col("target").alias("fn"), empty.alias("suffix")).distinct())
    known, rounds = state, 0
    while not state.isEmpty():
        more = state.join(begin.select("package_id", "fn"), ["package_id", "fn"], "left_anti").join(up, ["package_id", "fn"])
        more = more.select("package_id", "target", F.col("next").alias("fn"), F.when(F.col("step").isNull(), F.col("suffix")).otherwise(F.concat(F.array("step"), "suffix")).alias("suffix"))
        state = checkpointed(single(more.join(known.select("package_id", "target", "fn"), ["package_id", "target", "fn"], "left_anti"), ["package_id", "target", "fn"], ["suffix"]))
        known, rounds = known.unionByName(state), rounds + 1
        if rounds % 8 == 0:
            known = checkpointed(known)
    return known.join(begin, ["package_id", "fn"]).select("package_id", "target", F.concat("path", "suffix").alias("path")).distinct()


def vulnerability_kind(path: Column) -> Column:
    """The class of a call path by its first step and its length. The names are fixed values."""
    first, n = path[0]["type"], F.size(path)
    one = F.when(first == "Call", "VFunExported").when(first == "Method", "VFunPropOfExportedObj").when(first == "New", "VNewCall").when(first == "ServerInitialization", "VServerInitialization").when(first == "TopLevel", "VTopLevel")
    many = F.when(first == "New", "VNewCall").when(first.isin("Call", "Method"), "VFunRetByExport")
    return F.coalesce(F.when(n == 1, one).when(n > 1, many), F.lit("unknown"))


def summaries(paths: DataFrame) -> DataFrame:
    """package_id, target, path, type, source, calls: calls (each step's source text), outermost first; a leading top-level call before one other is left out."""
    kept = F.when((F.size("path") == 2) & (F.col("path")[0]["type"] == "TopLevel"), F.slice("path", 2, 1)).otherwise(F.col("path"))
    rows = paths.withColumn("path", kept)

    def text(c: Column, i: Column) -> Column:
        kind, prop, name = c["type"], c["prop"], c["fn_name"]
        first = F.when((kind == "Call") & name.isNotNull(), "module.exports").when(kind == "Method", F.concat(F.lit("module.exports."), prop)).when((kind == "New") & prop.isNull(), "new module.exports").when(kind == "New", F.concat(F.lit("new module.exports."), prop)).when(kind == "TopLevel", name).when(kind == "ServerInitialization", "")
        later = F.when((kind == "Call") & name.isNotNull(), "").when(kind == "Method", F.concat(F.lit("."), prop)).when(kind == "New", "new")
        return F.coalesce(F.when(i == 0, first).otherwise(later), F.lit("unknown"))

    calls = F.transform("path", text)
    return rows.select("package_id", "target", "path", vulnerability_kind(F.col("path")).alias("type"), F.get(calls, 0).alias("source"), calls.alias("calls"))
