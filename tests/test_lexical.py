import pytest

from graphloom.plans import detect, lexical
from graphloom.sources.graph_files import source_lines

PACKAGES = {
    "direct": ("function g(x) {\n  eval(x);\n}\nmodule.exports = { g };\n", [(2, "eval(x);")]),
    "private": ("function g(x) {\n  eval(x);\n}\nfunction f(y) { return y }\nmodule.exports = f;", []),
    "called": ("function g(x) { return x }\n// eval(no)\nfunction f(a, b) {\n  const v = g(a)\n  eval(v)\n}\nmodule.exports.f = f", [(5, "eval(v)")]),
    "safe": ('function g(x) { return "s" }\nfunction f(a) {\n  eval(g(a));\n}\nexports.f = f;', []),
    "nested": ("function h(x) { return x }\nfunction g(y) { var z = h(y); return z; }\nmodule.exports = function f(a) {\n  eval(g(h(a)));\n};", [(4, "eval(g(h(a)));")]),
    "through": ("function sink(s) {\n  eval(s);\n}\nfunction mid(m) { sink(m) }\nfunction f(a) { mid('x' + a) }\nmodule.exports = f;", [(2, "eval(s);")]),
    "library": ("var lib = require('lib');\nfunction f(a) {\n  var t = lib.trim(a, 1);\n  /* eval(a) */ eval(t);\n}\nmodule.exports = f", [(4, "/* eval(a) */ eval(t);")]),
    "argument": ("function f(a) {\n  eval('x', a);\n  run(a);\n}\nmodule.exports = f", []),
    "closure": ("function f(a) {\n  function inner() {\n    eval(a);\n  }\n  inner();\n}\nmodule.exports = f", [(3, "eval(a);")]),
    "empty": ("", []),
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(k, "main.js", text) for k, (text, _) in PACKAGES.items()] + [("two", "a.js", "function f(a) { g(a) }\nmodule.exports = f"), ("two", "b.js", "function g(x) {\n eval(x) }"), ("none", "n.js", None)]
    return spark.createDataFrame(rows, "package_id string, path string, content string")


def test_tokens(spark):
    df = spark.createDataFrame([("p", "f", 'a = "x;\\"" // c\n{ b(1,\n2) }')], "package_id string, path string, content string")
    got = [(r.token, r.line, r.round, r.curly) for r in lexical.tokens(df).orderBy("pos").collect()]
    assert got == [("a", 1, 0, 0), ("=", 1, 0, 0), ('"x;\\""', 1, 0, 0), ("{", 2, 0, 0), ("b", 2, 0, 1), ("(", 2, 0, 1), ("1", 2, 1, 1), (",", 2, 1, 1), ("2", 3, 1, 1), (")", 3, 1, 1), ("}", 3, 0, 1)]


def test_detections_from_source(spark, files):
    sinks = spark.createDataFrame([("code-injection", "eval", "function", None, 1, 0)], "vuln_type string, sink string, kind string, package string, arg int, ord int")
    graph = lexical.program_graph(files, sinks)
    assert graph.nodes.groupBy("package_id", "node_id").count().where("count > 1").collect() == []
    found = detect.injections(graph, sinks, source_lines(files)).collect()
    got = {k: sorted((r.sink_lineno, r.sink) for r in found if r.package_id == k) for k in [*PACKAGES, "two", "none"]}
    assert got == {k: want for k, (_, want) in PACKAGES.items()} | {"two": [(2, "eval(x) }")], "none": []}
