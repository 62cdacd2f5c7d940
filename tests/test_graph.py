import random

import pytest
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.operators.closure import paths, reach, reached
from graphloom.operators.match import ends, first_match, hop, label, missing, optional, single, start
from graphloom.plans import detect, flow, param_types, protocol
from graphloom.sources import graph_files, samples
from graphloom.sources.table_graph import table_graph
from tests import graphs

SINKS = [("code-injection", "eval", "function", None, 1, 0), ("command-injection", "exec", "package", "child_process", 1, 1000), ("path-traversal", "eval", "function", None, 1, 2000)]


@pytest.fixture(scope="module")
def sinks(spark):
    return spark.createDataFrame(SINKS, "vuln_type string, sink string, kind string, package string, arg int, ord int")


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def random_graph(spark, seed):
    rng = random.Random(seed)
    edges = [(f"p{rng.randrange(3)}", rng.randrange(12), rng.randrange(12)) for _ in range(40)]
    return edges, spark.createDataFrame(edges, "package_id string, src long, dst long")


def closed(edges, seeds, min_hops, max_hops=99):
    out = set()
    for p, o, s in seeds:
        level, seen = {s}, {s} if min_hops == 0 else set()
        for _ in range(max_hops):
            level = {b for q, a, b in edges if q == p and a in level} - seen
            if not level:
                break
            seen |= level
        out |= {(p, o, n) for n in seen}
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [0, 1000])
@pytest.mark.parametrize("min_hops,max_hops", [(0, None), (1, None), (1, 2)])
def test_reach_both_ways(spark, seed, small, min_hops, max_hops):
    edges, df = random_graph(spark, seed)
    seeds = [("p0", 100, 1), ("p0", 100, 2), ("p1", 7, 3), ("p2", 3, 3), ("none", 1, 1)]
    s = spark.createDataFrame(seeds, "package_id string, origin long, node long")
    assert rows(reach(df, s, min_hops, max_hops, small=small)) == closed(edges, seeds, min_hops, max_hops or 99)


def test_reached_backward_and_empty(spark):
    df = spark.createDataFrame([("p", 1, 2), ("p", 2, 3), ("p", None, 3), ("p", 2, 3)], "package_id string, src long, dst long")
    seeds = spark.createDataFrame([("p", 3), ("p", None)], "package_id string, node long")
    assert rows(reached(df, seeds, backward=True)) == [("p", 1), ("p", 2)]
    assert rows(reached(df, seeds.where("false"))) == []
    assert rows(reached(df.where("false"), seeds, min_hops=0)) == [("p", 3)]


def test_paths(spark):
    df = spark.createDataFrame([("p", 1, 2), ("p", 2, 3), ("p", 1, 3)], "package_id string, src long, dst long")
    got = paths(spark, df, spark.createDataFrame([("p", 1)], "package_id string, node long"), 5)
    assert sorted(r.path for r in got.collect()) == [[1], [1, 2], [1, 2, 3], [1, 3]]


def test_large_packages_take_few_rounds(spark):
    """A long chain with a ladder and a star behind it, closed by all executors; all seeds of a shorter chain by doubling."""
    chain = [("c", i, i + 1) for i in range(300)]
    ladder = [("c", a, b) for i in range(300, 340, 2) for a in (i, i + 1) for b in (i + 2, i + 3)]
    edges = chain + ladder + [("c", 10, 1000 + k) for k in range(50)] + [("c", 200, 150), ("d", 1, 2)]
    df = spark.createDataFrame(edges, "package_id string, src long, dst long")
    seeds = [("c", 7, 0), ("c", 8, 150), ("d", 1, 1)]
    got = reach(df, spark.createDataFrame(seeds, "package_id string, origin long, node long"), 1, small=0)
    assert rows(got) == closed(edges, seeds, 1, 9999)
    short = spark.createDataFrame(chain[:40], "package_id string, src long, dst long")
    own = short.select("package_id", F.col("src").alias("origin"), F.col("src").alias("node"))
    assert reach(short, own, small=0).count() == 40 * 41 // 2


def test_many_pairs_in_one_task(spark):
    """Every pair of a chain of 1,500, and repeated seeds, lone seeds and another package beside it."""
    chain = spark.range(1500).select(F.lit("c").alias("package_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    own = chain.select("package_id", F.col("src").alias("origin"), F.col("src").alias("node"))
    lone = spark.createDataFrame([("c", 5, 99999), ("b", 1, 1), ("b", 1, 1)], "package_id string, origin long, node long")
    assert reach(chain, own.unionByName(lone)).count() == 1500 * 1501 // 2
    assert reach(chain, own.unionByName(own).unionByName(lone), 0).count() == 1500 * 1501 // 2 + 1500 + 2


def test_ends_without_types(spark):
    g = graphs.graph(spark, *graphs.exported_eval())
    assert rows(ends(g, g.e("REF"), ["VariableDeclarator"], ["PDG_CALL"]), "src", "dst") == [(1, 9), (4, 9)]


def test_match_operators(spark):
    g = graphs.graph(spark, *graphs.exported_eval())
    found = hop(g, start(g, "f", "VariableDeclarator", keep={"name": "identifier_name"}), "f", "o", "REF", "obj")
    assert rows(found, "name", "o") == [("g", 11), ("v1", 9), ("v1", 10)]
    assert rows(label(g, found, "o", "PDG_CALL"), "f", "o") == [(4, 9)]
    assert rows(optional(g, start(g, "f", "VariableDeclarator"), "f", "c", "FD"), "f") == [(1,), (4,)]
    assert rows(missing(start(g, "f", "VariableDeclarator"), g.e("FD").select("package_id", F.col("src").alias("f")), "f"), "f") == [(4,)]
    assert rows(single(found, ["f"], ["o"]), "f", "o") == [(1, 11), (4, 9)]
    a, b = found.where("f = 4").select("f", "o"), found.select("f", F.lit(0).cast("long").alias("o"))
    assert rows(first_match([a, b], ["f"]), "f", "o") == [(1, 0), (4, 9), (4, 10)]


def test_injection(spark, sinks):
    lines = graph_files.source_lines(spark.createDataFrame([("p", "main.js", "function g(x) {\n  eval(x);\n}")], "package_id string, path string, content string"))
    g = graphs.graph(spark, *graphs.exported_eval())
    want = [("p", "main.js", "code-injection", "eval(x);", 2, 4)]
    assert rows(detect.injections(g, sinks, lines)) == want
    assert rows(detect.injections(g, sinks, lines, "intra")) == want
    assert rows(detect.detections(g, sinks, lines)) == want
    silent = graphs.graph(spark, *graphs.exported_eval(False))
    assert rows(detect.injections(silent, sinks, lines)) == []
    assert rows(detect.injections(silent, sinks, lines, "intra")) == []


def test_flow_needs_a_return(spark, sinks):
    good, bad = graphs.graph(spark, *graphs.call_chain(), package="good"), graphs.graph(spark, *graphs.call_chain(False), package="bad")
    found = detect.injections(graphs.union(good, bad), sinks)
    assert rows(found, "package_id", "sink_lineno") == [("good", 7)]
    # without regard to calls both have the dependency
    assert rows(detect.injections(graphs.union(good, bad), sinks, query="intra"), "package_id") == [("bad",), ("good",)]


def test_confirmed_over_a_caller(spark, sinks):
    g = graphs.graph(spark, *graphs.caller_of_sink())
    f = flow.flow_of(g)
    assert rows(f.confirmed) == [("p", 6), ("p", 16)]
    assert rows(detect.injections(g, sinks, flow=f), "sink_lineno") == [(2,)]
    assert rows(flow.callers_by_callee(g).withColumn("callers", F.to_json("callers"))) == [("p", 1, "[11]")]
    assert rows(flow.parameter_edges(g)) == [("p", 16, 6)]


def test_recursion_ends(spark, sinks):
    nodes, edges = graphs.caller_of_sink()
    edges += [(1, 17, "REF", "call", None), (17, 11, "CG", "CG", None), (6, 17, "PDG", "ARG", "13.a-o2")]
    assert rows(detect.injections(graphs.graph(spark, nodes, edges), sinks), "sink_lineno") == [(2,)]


@pytest.mark.parametrize("query", ["bottom_up", "intra"])
def test_pollution(spark, query):
    yes, no = graphs.graph(spark, *graphs.polluted(), package="yes"), graphs.graph(spark, *graphs.polluted(False), package="no")
    found = detect.pollutions(graphs.union(yes, no), query=query)
    assert rows(found, "package_id", "vuln_type", "sink_lineno") == [("yes", "prototype-pollution", 2)]


def test_pollution_patterns(spark):
    g = graphs.graph(spark, *graphs.polluted())
    assert rows(detect.pollution_patterns(g)) == [("p", 10, 10, 12, 13, 22), ("p", 10, 11, 12, 13, 22)]
    assert rows(detect.pollution_patterns_intra(g)) == [("p", 10, 20, 21, 22)]


def test_call_path_of_a_direct_export(spark):
    g = graphs.graph(spark, *graphs.exported_eval())
    assert rows(protocol.parent_functions(g)) == [("p", 1, 4)]
    targets = spark.createDataFrame([("p", 1)], "package_id string, target long")
    got = protocol.summaries(protocol.call_paths(g, targets)).collect()
    assert [(r.type, r.source, r.path[0].fn_name) for r in got] == [("VFunExported", "module.exports", "0.g-o4")]


def test_call_path_over_a_caller(spark):
    nodes, edges = graphs.call_chain()
    nodes += [(41, "PDG_OBJECT", "0.f-o9"), (42, "PDG_OBJECT", "0.module-o10"), (43, "PDG_OBJECT", "0.module.exports-o11")]
    edges += [(1, 41, "REF", "obj", None), (41, 43, "PDG", "DEP", None), (42, 43, "PDG", "SO", "exports")]
    g = graphs.graph(spark, nodes, edges)
    assert rows(protocol.callers(g)) == [("p", 21, 1)]
    got = protocol.call_paths(g, spark.createDataFrame([("p", 21)], "package_id string, target long")).collect()
    assert [[s.fn_id for s in r.path] for r in got] == [[1]]


def test_call_path_over_many_callers(spark):
    """function f0() { sink() }, f1() { f0() }, ..., the last of 70 exported."""
    nodes, edges = [(1, "PDG_OBJECT", "0.f-o1"), (2, "PDG_OBJECT", "0.module-o2"), (3, "PDG_OBJECT", "0.module.exports-o3")], [(1, 3, "PDG", "DEP", None), (2, 3, "PDG", "SO", "exports")]
    for k in range(70):
        i = 100 + 10 * k
        nodes += [(i, "VariableDeclarator", f"f{k}"), (i + 1, "FunctionExpression", "anon", {"location": graphs.location(k)}), (i + 2, "CFG_F_START", f"{i + 1}_anon"), (i + 3, "VariableDeclarator", "v", {"function_context": i + 2})]
        edges += [(i, i + 1, "AST", "init", None), (i, i + 2, "FD", "FD", None), (i + 2, i + 3, "CFG", None, None)] + [(i + 3, i - 10, "CG", "CG", None)] * (k > 0)
    edges.append((i, 1, "REF", "obj", None))
    got = protocol.call_paths(graphs.graph(spark, nodes, edges), spark.createDataFrame([("p", 100)], "package_id string, target long")).collect()
    assert [[s.fn_id for s in r.path] for r in got] == [[i]]


def test_callbacks(spark):
    """A function passed to a Promise, to then and to another call."""
    nodes, edges = samples.PROGRAMS[3]
    g = graphs.graph(spark, [(i, t, n, {"function_context": m["ctx"]} if "ctx" in m else {}) for i, t, n, m in nodes], [e[:5] for e in edges])
    assert rows(protocol.callbacks(g), "fn", "caller", "kind") == [(10, 70, "callback"), (10, 70, "promise"), (10, 70, "then")]
    assert (10, 70) in rows(protocol.callers(g), "fn", "caller")


def test_keys_too_large_for_node_ids(spark, tmp_path):
    """1,500 turns and line number 12 keep their own ids; a number beyond the factor is an error."""
    import shutil

    for t in ("region", "nation", "customer", "supplier", "part", "orders", "events", "lineitem", "conversations"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    talk = [(c, t, "user", "x") for c in (1, 2) for t in range(1500)]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/conversations.parquet")
    items = spark.read.parquet("file:///root/testdata/sf0.001/lineitem.parquet").limit(1)
    items.withColumn("l_linenumber", F.lit(12).cast(items.schema["l_linenumber"].dataType)).unionByName(items).coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/lineitem.parquet")
    g = table_graph(spark, f"file://{tmp_path}")
    assert g.n("Turn").select("node_id").distinct().count() == 3000
    assert ends(g, g.e("CFG"), ["Turn"]).count() == 2998
    assert g.n("LineItem").select("node_id").distinct().count() == 2
    spark.createDataFrame([(1, 10**6, "user", "x")], "conv_id long, turn int, role string, text string").coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/conversations.parquet")
    with pytest.raises(Exception, match="too large"):
        table_graph(spark, f"file://{tmp_path}").n("Turn").collect()


def test_exported_property(spark):
    """exports.p = f."""
    nodes = [(1, "VariableDeclarator", "f"), (2, "FunctionExpression", None, {"location": graphs.location(1)}), (3, "PDG_OBJECT", "0.f-o1"), (4, "PDG_OBJECT", "0.exports.p-o3"), (5, "PDG_OBJECT", "0.exports-o2"), (6, "ExpressionStatement", None)]
    edges = [(1, 2, "AST", "init", None), (1, 3, "REF", "obj", None), (3, 4, "PDG", "DEP", None), (5, 4, "PDG", "SO", "p"), (6, 5, "REF", "obj", None)]
    g = graphs.graph(spark, nodes, edges)
    got = protocol.exported_types(g).collect()
    assert [[(s.type, s.prop) for s in r.path] for r in got] == [[("Method", "p")]]
    assert protocol.summaries(protocol.call_paths(g, spark.createDataFrame([("p", 1)], "package_id string, target long"))).collect()[0].source == "module.exports.p"


def test_returned_function(spark):
    """function f() { function g() {}; return g }; module.exports = f."""
    nodes = [
        (1, "VariableDeclarator", "f"), (2, "FunctionExpression", None, {"location": graphs.location(1)}), (3, "PDG_OBJECT", "0.f-o1"), (4, "PDG_OBJECT", "0.module.exports-o3"), (5, "PDG_OBJECT", "0.module-o2"),
        (11, "VariableDeclarator", "g"), (12, "FunctionExpression", None, {"location": graphs.location(2)}), (13, "PDG_OBJECT", "9.g-o4"), (14, "PDG_RETURN", None), (15, "ReturnStatement", None), (16, "BlockStatement", None),
    ]
    edges = [
        (1, 2, "AST", "init", None), (1, 3, "REF", "obj", None), (3, 4, "PDG", "DEP", None), (5, 4, "PDG", "SO", "exports"), (11, 12, "AST", "init", None), (11, 13, "REF", "obj", None), (13, 14, "PDG", "DEP", None),
        (15, 14, "REF", "obj", None), (2, 16, "AST", "block", None), (16, 15, "AST", "stmt", None),
    ]
    got = protocol.summaries(protocol.call_paths(graphs.graph(spark, nodes, edges), spark.createDataFrame([("p", 11)], "package_id string, target long"))).collect()
    assert [(r.type, [(s.type, s.fn_name) for s in r.path]) for r in got] == [("VFunRetByExport", [("Call", "0.f-o1"), ("Call", "9.g-o4")])]


def test_server_ports(spark):
    src = [("p", "a.js", 'http.createServer(f).listen("80")'), ("p", "b.js", "createServer(f).listen(8080)"), ("p", "c.js", "x.listen(1)"), ("p", "d.js", "recreateServer().listen(2)")]
    assert rows(protocol.server_ports(spark.createDataFrame(src, "package_id string, path string, content string"))) == [("p", "a.js", 80), ("p", "b.js", 8080)]


def test_parameter_types(spark, sinks):
    """function f(x, n, o, z): x + "s", n * 2, o.a read, z not used."""
    nodes = [(1, "VariableDeclarator", "f"), (10, "PDG_OBJECT", "3.x-o1"), (11, "PDG_OBJECT", "3.n-o2"), (12, "PDG_OBJECT", "3.o-o3"), (13, "PDG_OBJECT", "3.o.a-o4"), (14, "PDG_OBJECT", "3.z-o5"), (15, "PDG_OBJECT", "3.this-o6")]
    nodes += [(20, "BinaryExpression", None, {"sub_type": "+"}), (21, "Identifier", "x"), (22, "Literal", None, {"sub_type": "string", "raw": "'s'"}), (30, "BinaryExpression", None, {"sub_type": "*"}), (31, "Identifier", "n"), (32, "Literal", None, {"sub_type": "number", "raw": "2"}), (40, "CallExpression", None), (41, "Identifier", "a")]
    edges = [*((1, i, "REF", "param", None, {"param_index": k}) for k, i in enumerate((10, 11, 12, 14))), (1, 15, "REF", "param", None, {"is_this": True}), (12, 13, "PDG", "SO", "a"), (20, 21, "AST", "left", None), (20, 22, "AST", "right", None), (30, 31, "AST", "left", None), (30, 32, "AST", "right", None), (40, 41, "AST", "callee", None)]
    g = graphs.graph(spark, nodes, edges)
    trees = param_types.parameter_trees(g, spark.createDataFrame([("p", 1)], "package_id string, fn long"))
    signatures = spark.createDataFrame([], "fn string, args_types array<string>, rest boolean")
    got = param_types.inferred(g, trees, sinks, signatures, spark.createDataFrame([("string", "charAt")], "kind string, method string"))
    assert sorted((r.param, tuple(r.prefix), tuple(r.types)) for r in got.collect()) == [("n", (), ("number",)), ("o", (), ("any",)), ("o", ("a",), ("function",)), ("x", (), ("string",)), ("z", (), ("any",))]
    assert rows(got.select(param_types.folded(F.col("types")).alias("t")).distinct())[-1][0] in ('"string"',)


def test_parameter_trees_have_no_end(spark):
    """A property after 15 versions of o; o.next.next is o again; a parameter without an index on a cycle."""
    nodes = [(1, "VariableDeclarator", "f"), (10, "PDG_OBJECT", "3.o-o1"), (11, "PDG_OBJECT", "3.o.next-o2"), (12, "PDG_OBJECT", "3.q-o3"), (13, "PDG_OBJECT", "3.q-o4"), *((20 + k, "PDG_OBJECT", f"3.p-o{k}") for k in range(17))]
    edges = [(1, 10, "REF", "param", None, {"param_index": 0}), (10, 11, "PDG", "SO", "next"), (11, 10, "PDG", "SO", "next"), (1, 12, "REF", "param", None), (12, 13, "PDG", "DEP", "q"), (13, 12, "PDG", "DEP", "q"), (1, 20, "REF", "param", None, {"param_index": 1})]
    edges += [*((20 + k, 21 + k, "PDG", "NV", None) for k in range(15)), (35, 36, "PDG", "SO", "deep")]
    trees = param_types.parameter_trees(graphs.graph(spark, nodes, edges), spark.createDataFrame([("p", 1)], "package_id string, fn long"))
    got = {(r.param, tuple(r.prefix)): tuple(r.ids) for r in trees.collect()}
    assert got == {("o", ()): (10,), ("o", ("next",)): (11,), ("o", ("next", "next")): (10,), ("q", ()): (12, 13), ("p", ()): tuple(range(20, 36)), ("p", ("deep",)): (36,)}


def test_csv_files(spark, tmp_path):
    g = graphs.graph(spark, *graphs.exported_eval(), package="main")
    graph_files.write_graph(g, f"file://{tmp_path}/n", f"file://{tmp_path}/r")
    back = graph_files.read_graph(spark, f"file://{tmp_path}/n", f"file://{tmp_path}/r")
    keys = ("node_id", "type", "identifier_name", "function_context", "location.start.line")
    none_last = lambda t: [(x is None, x) for x in t]
    assert sorted(map(none_last, rows_of(back.nodes, *keys))) == sorted(map(none_last, rows_of(g.nodes, *keys)))
    assert back.edges.count() == g.edges.count()
    assert rows(back.edges.where("param_index = 0"), "src", "dst") == [(1, 6)]
    assert rows(back.counts(), "n_nodes", "n_edges") == [(13, 16)]
    graph_files.write_parquet(PropertyGraph(g.nodes, g.edges), f"file://{tmp_path}/q")
    assert graph_files.read_parquet(spark, f"file://{tmp_path}/q").edges.count() == 16


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_merge_keeps_one_edge(spark, tmp_path):
    nodes, edges = graphs.exported_eval()
    g = graphs.graph(spark, nodes, [*edges, (6, 8, "PDG", "DEP", "again"), (6, 99, "PDG", "DEP", "dangling")])
    graph_files.write_graph(g, f"file://{tmp_path}/n", f"file://{tmp_path}/r")
    read = lambda merge: graph_files.read_graph(spark, f"file://{tmp_path}/n", f"file://{tmp_path}/r", merge=merge).edges.where("src = 6 and rel_type = 'PDG' and dst = 8").count()
    assert (read(False), read(True)) == (2, 1)


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"sinks": {"code-injection": [{"sink": "eval", "type": "function", "args": [1, 2]}], "command-injection": [{"sink": "exec", "type": "package", "packages": [{"package": "child_process", "args": [1]}]}]}, "functions-signatures": {"join": {"package": "path", "args_types": ["string"], "rest?": true}}, "prototypes": {"array": ["map"]}}')
    tables = graph_files.read_config(spark, f"file://{tmp_path}/c.json")
    assert rows(tables["sinks"].fillna(""), "vuln_type", "sink", "package", "arg") == [("code-injection", "eval", "", 1), ("code-injection", "eval", "", 2), ("command-injection", "exec", "child_process", 1)]
    assert rows(tables["prototypes"]) == [("array", "map")]
    assert [(r.fn, r.args_types, r.rest) for r in tables["signatures"].collect()] == [("join", ["string"], True)]


def test_leaves_of_hubs_go_in_one_round(spark):
    """A tree of hubs is contracted in a few rounds, not in as many as the logarithm of its leaves."""
    from graphloom.operators.closure import _contracted

    edges = [("t", 0, h) for h in range(1, 6)] + [("t", h, 10_000 * h + i) for h in range(1, 6) for i in range(400)]
    df = spark.createDataFrame(edges, "package_id string, src long, dst long")
    root = spark.createDataFrame([("t", 0)], "package_id string, node long")
    core, taken = _contracted(df, root)
    assert core.isEmpty() and len(taken) <= 3 and sum(t.count() for t in taken) == len(edges)
    seeds = root.select("package_id", F.col("node").alias("origin"), "node")
    assert reach(df, seeds, 0, small=0).count() == len(edges) + 1


def test_compressed_files_are_read_again(spark, tmp_path):
    g = graphs.graph(spark, *graphs.exported_eval())
    graph_files.write_graph(g, f"{tmp_path}/n", f"{tmp_path}/e", compression="gzip")
    assert list((tmp_path / "n").glob("*.csv.gz")) and list((tmp_path / "e").glob("*.csv.gz"))
    back = graph_files.read_graph(spark, f"{tmp_path}/n", f"{tmp_path}/e")
    assert back.nodes.count() == g.nodes.count() and back.edges.count() == g.edges.count()


def test_walks_of_graphs_counted_once(spark):
    """The way without counts gives what a plain search gives: cycles, loops, repeated rows, seeds without edges, ids of any sign, the same ids in packages."""
    steps = [("p", 1, 2), ("p", 2, 3), ("p", 3, 1), ("p", 2, 3), ("p", 4, 4), ("p", -5, 1), ("q", 1, 9), ("q", 9, -5), ("r", 1, None), (None, 1, 2)]
    starts = [("p", 1, 1), ("p", 1, 1), ("p", 7, 4), ("p", 0, -5), ("p", 8, 8), ("q", 1, 1), ("q", 9, 9), ("s", 3, 3)]
    edges = spark.createDataFrame(steps, "package_id string, src long, dst long")
    seeds = spark.createDataFrame(starts, "package_id string, origin long, node long")
    for hops in (0, 1):
        for back in (False, True):
            ways = [(p, b, a) if back else (p, a, b) for p, a, b in steps]
            want = set()
            for p, o, n in set(starts):
                seen, todo = ({n}, [n]) if hops == 0 else (set(), [n])
                while todo:
                    at = todo.pop()
                    new = {b for q, a, b in ways if q == p and a == at and b is not None} - seen
                    seen |= new
                    todo += new
                want |= {(p, o, x) for x in seen}
            for few in (False, True):
                got = [tuple(r) for r in reach(edges, seeds, hops, backward=back, few=few).select("package_id", "origin", "node").collect()]
                assert sorted(got) == sorted(want), (hops, back, few)


def test_few(spark):
    """One package with too many pairs, and walks of the whole graph are counted one by one."""
    little = graphs.graph(spark, *graphs.exported_eval())
    much = graphs.graph(spark, [(i, "PDG_OBJECT", "x") for i in range(1500)], [(i, i + 1, "PDG", "NV", None) for i in range(1499)], package="q")
    assert little.few and not graphs.union(little, much).few


def test_corpus_is_dealt_over_files(spark, tmp_path):
    """Suppliers are one small file; the graph that is made of them is not one task's."""
    spark.range(1, 101).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    g = samples.corpus(spark, str(tmp_path))
    assert len(g.edges.inputFiles()) > 1 and len(g.nodes.inputFiles()) > 1
    assert g.few and g.edges.select("package_id").distinct().count() == 100
