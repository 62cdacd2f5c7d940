import json

from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.plans import packages
from graphloom.sources import graph_files
from graphloom.streaming.arrivals import detect_arrivals
from tests import graphs

FILES = [
    ("a", "package.json", '{"main": "./lib/main"}'), ("a", "lib/main.js", "const x = require('./util'), y = require(\"../top\");\nconst z = require('fs')"), ("a", "lib/util/index.js", "import q from '../../top.js'"), ("a", "top.js", "require('./missing')"), ("a", "other.js", ""),
    ("b", "src/index.js", ""), ("b", "dist/index.js", ""), ("c", "package.json", "not json"), ("c", "index.js", "require('./index')"), ("d", "readme.md", "x"),
]


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def config(spark):
    return {
        "sinks": spark.createDataFrame([("code-injection", "eval", "function", None, 1, 0)], "vuln_type string, sink string, kind string, package string, arg int, ord int"),
        "signatures": spark.createDataFrame([], "fn string, args_types array<string>, rest boolean"),
        "prototypes": spark.createDataFrame([("string", "charAt")], "kind string, method string"),
    }


def test_files(spark):
    files = spark.createDataFrame(FILES, "package_id string, path string, content string")
    assert rows(packages.entry_files(files)) == [("a", "lib/main.js"), ("b", "src/index.js"), ("c", "index.js")]
    assert rows(packages.file_dependencies(files)) == [("a", "lib/main.js", "lib/util/index.js"), ("a", "lib/main.js", "top.js"), ("a", "lib/util/index.js", "top.js"), ("c", "index.js", "index.js")]
    assert rows(packages.dependency_closure(files, packages.entry_files(files))) == [("a", "lib/main.js"), ("a", "lib/util/index.js"), ("a", "top.js"), ("b", "src/index.js"), ("c", "index.js")]
    assert rows(packages.dependency_text(files))[0] == ("a", "lib/main.js: lib/util/index.js, top.js")


def test_normal(spark):
    got = spark.createDataFrame([("a/./b/../c",), ("../x",), ("",), (None,)], "p string").select(packages.normal(F.col("p")).alias("n")).collect()
    assert [r.n for r in got] == ["a/c", "x", "", None]


def test_summary(spark):
    g = graphs.graph(spark, *graphs.exported_eval())
    timers = packages.Timers()
    got = packages.analyse(g, config(spark), with_types=True, timers=timers).collect()
    assert len(got) == 1
    assert [r.stage for r in timers.table(spark).collect()] == ["call_graph", "injection_detection", "proto_pollution_detection", "reconstruction"]
    assert json.loads(got[0].summary) == {"type": "VFunExported", "filename": "main.js", "vuln_type": "code-injection", "sink": "", "sink_lineno": 2, "source": "module.exports", "tainted_params": ["x"], "params_types": {"x": "any"}}


def test_parameter_json(spark):
    data = [("p", 1, "o", [], 0, []), ("p", 1, "o", ["a"], 0, ["string"]), ("p", 1, "o", ["a", "length"], 0, []), ("p", 1, "q", [], 1, ["number", "string"]), ("p", 1, "r", [], 2, []), ("p", 1, "r", ["*"], 2, [])]
    types = spark.createDataFrame(data, "package_id string, fn long, param string, prefix array<string>, param_index int, types array<string>")
    got = packages.parameter_json(types).collect()[0]
    assert got.tainted_params == ["o", "q", "r"]
    assert json.loads(got.params_types) == {"o": {"a": {"_union": [{"length": "any"}, "string", "array"]}}, "q": {"_union": ["number", "string"]}, "r": {"*": "any"}}
    polluted = spark.createDataFrame([("p", 1, "r", "object"), ("p", 1, "q", "value")], "package_id string, fn long, param string, role string")
    got = packages.parameter_json(types, ("charAt",), polluted).collect()[0]
    assert json.loads(got.params_types) == {"o": {"a": {"_union": ["object", ["string", "string"], "string"]}}, "q": {"_union": ["number", "string"]}, "r": "object"}


def test_numeric_keys_are_an_array(spark):
    """Keys 0, 2 and 10, given in the order of their text: each at its index, any between; an only any; keys with other names."""
    data = [("p", 1, "k", [], 0, []), *(("p", 1, "k", [n], 0, [t]) for n, t in (("0", "string"), ("10", "number"), ("2", "bool"))), ("p", 1, "m", [], 1, []), ("p", 1, "m", ["0"], 1, []), ("p", 1, "n", [], 2, []), ("p", 1, "n", ["1"], 2, []), ("p", 1, "n", ["b"], 2, [])]
    types = spark.createDataFrame(data, "package_id string, fn long, param string, prefix array<string>, param_index int, types array<string>")
    none = spark.createDataFrame([], "package_id string, fn long, param string, role string")
    got = {r.param: json.loads(r.json) for r in packages.folded_parameters(types, (), none).collect()}
    assert got == {"k": ["string", "any", "bool", *["any"] * 7, "number"], "m": "array", "n": {"_union": [{"1": "any", "b": "any"}, ["any", "any"]]}}


def test_drawing(spark):
    g = graphs.graph(spark, *graphs.exported_eval())
    lines = [r.line for r in packages.drawing(g, ("AST",)).orderBy("part", "line").collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and sum(" -> " in x for x in lines) == 16 - 2
    assert '  7 -> 6 [label="PDG:TAINT"];' in lines


def test_arrivals(spark, tmp_path):
    g = graphs.union(graphs.graph(spark, *graphs.exported_eval(), package="x"), graphs.graph(spark, *graphs.exported_eval(False), package="y"))
    n, e, out = (f"file://{tmp_path}/{k}" for k in ("n", "e", "out"))
    g.edges.write.parquet(e)
    g.nodes.repartition(1).write.parquet(n)
    q = detect_arrivals(spark, n, e, config(spark), out, f"file://{tmp_path}/ck")
    q.awaitTermination(120)
    assert rows(spark.read.parquet(out), "package_id", "sink_lineno") == [("x", 2)]
    assert graph_files.read_parquet is not None


T = "package_id string, fn long, param string, prefix array<string>, param_index int, types array<string>"


def test_numeric_keys_of_any_size(spark):
    """One package's keys cost what they hold, whatever they are; others are not harmed."""
    keys = ["0", "2", "70", "3000000", "400000000", "3000000000", "9" * 40]
    data = [("p", 1, "o", [], 0, [])] + [("p", 1, "o", [k], 0, ["number"]) for k in keys] + [("q", 1, "o", [], 0, []), ("q", 1, "o", ["0"], 0, [])]
    none = spark.createDataFrame([], "package_id string, fn long, param string, role string")
    got = {r.package_id: json.loads(r.json) for r in packages.folded_parameters(spark.createDataFrame(data, T), (), none).collect()}
    gap = lambda a, b: {"_any": b - a - 1}
    assert got["q"] == "array"
    assert got["p"] == ["number", "any", "number", gap(2, 70), "number", gap(70, 3_000_000), "number", gap(3_000_000, 400_000_000), "number", gap(400_000_000, 3_000_000_000), "number", gap(3_000_000_000, int(keys[-1])), "number"]


def test_folding_odd_names_roles_and_depth(spark):
    data = [("p", 1, "o", [], 0, []), ("p", 1, "o", ['a"b'], 0, ["string"]), ("p", 1, "o", ["é\\"], 0, []), ("p", 1, "d", [], 1, []), *(("p", 1, "d", ["n"] * k, 1, ["number"]) for k in range(1, 200))]
    data += [("p", 1, "v", [], 2, []), ("p", 1, "v", ["length"], 2, []), ("p", 1, "w", [], None, []), ("p", 1, "w", ["1"], None, ["bool"]), ("p", 1, "w", ["x"], None, []), ("p", 1, "x", [], 4, []), ("p", 1, "x", ["length"], 4, []), ("p", 1, "x", ["charAt"], 4, ["function"])]
    polluted = spark.createDataFrame([("p", 1, "v", "value"), ("p", 1, "o", "object")], "package_id string, fn long, param string, role string")
    got = {r.param: (r.param_index, r.json) for r in packages.folded_parameters(spark.createDataFrame(data, T), ("charAt",), polluted).collect()}
    assert json.loads(got["o"][1]) == {'a"b': "string", "é\\": "any"}
    assert got["d"][1].count('"n"') == 199 and got["d"][0] == 1
    assert got["v"][1] == packages.POLLUTING and got["x"][1] == packages.TEXT
    assert got["w"] == (None, '{"_union":[{"1":"bool","x":"any"},["any","bool"]]}')


def test_drawing_from_start_nodes(spark):
    """The walk does not enter what is ignored, goes round a cycle once, and draws nothing of what it does not come to."""
    n = [("p", 1, "TAINT_SOURCE", None), ("p", 2, "PDG_OBJECT", 'a"b'), ("p", 3, "Literal", "x"), ("p", 4, "VariableDeclarator", "skip"), ("p", 5, "VariableDeclarator", "behind"), ("p", 6, "CFG_F_START", "far"), ("p", 7, None, "untyped"), ("q", 1, "TAINT_SOURCE", "skip")]
    e = [("p", i, a, b, rel, None, None) for i, (a, b, rel) in enumerate([(1, 2, "PDG"), (2, 1, "REF"), (2, 3, "PDG"), (2, 4, "PDG"), (4, 5, "PDG"), (6, 2, "CFG"), (2, 7, "CG"), (1, 5, "AST"), (2, 2, None), (2, 9, "PDG")])]
    g = PropertyGraph(spark.createDataFrame(n, "package_id string, node_id long, type string, identifier_name string"), spark.createDataFrame(e, "package_id string, edge_id long, src long, dst long, rel_type string, relation_type string, identifier_name string"))
    starts = spark.createDataFrame([("p", 1), ("p", 1), ("q", 1), ("r", 1), ("p", None)], "package_id string, node long")
    exported = spark.createDataFrame([("p", 7)], "package_id string, node long")
    got = rows(packages.drawing_from(g, starts, ("AST", "Literal"), ("skip",), exported))
    assert {p for p, _, _ in got} == {"p"}
    assert [line for _, part, line in got if part == 1] == [
        '  1 [label="1 TAINT_SOURCE" color=goldenrod4 fontcolor=goldenrod4];',
        """  2 [label="2 PDG_OBJECT a'b" color=darkgreen fontcolor=darkgreen];""",
        '  7 [label="7 untyped" color=darkviolet fontcolor=darkviolet];',
    ]
    assert [line for _, part, line in got if part == 2] == [
        '  1 -> 2 [label="PDG" color=darkgreen fontcolor=darkgreen style=solid];',
        '  2 -> 1 [label="REF" color=black fontcolor=black style=dashed];',
        '  2 -> 2 [label="" color=black fontcolor=black style=solid];',
        '  2 -> 7 [label="CG" color=goldenrod3 fontcolor=goldenrod3 style=solid];',
    ]
    assert rows(packages.drawing_from(g, starts.where("false"))) == []
