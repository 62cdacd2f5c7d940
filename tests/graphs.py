"""Small program graphs, written by hand."""

from graphloom.model import EDGES, NODES, PropertyGraph


def location(line, fname="main.js"):
    return {"start": {"line": line, "column": 0}, "end": {"line": line, "column": 1}, "fname": fname}


def graph(spark, nodes, edges, package="p"):
    """nodes: (id, type, name, optional dict); edges: (src, dst, rel, relation, name, optional dict)."""
    n = [{"package_id": package, "node_id": i, "type": t, "identifier_name": name, **(more[0] if more else {})} for i, t, name, *more in nodes]
    e = [{"package_id": package, "edge_id": k, "src": a, "dst": b, "rel_type": rel, "relation_type": relation, "identifier_name": name, **(more[0] if more else {})} for k, (a, b, rel, relation, name, *more) in enumerate(edges)]
    return PropertyGraph(spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES))


def union(*graphs):
    out = graphs[0]
    for g in graphs[1:]:
        out = PropertyGraph(out.nodes.unionByName(g.nodes), out.edges.unionByName(g.edges))
    return out


def exported_eval(exported=True):
    """function g(x) { eval(x) }; module.exports = g, with x tainted if exported."""
    nodes = [
        (1, "VariableDeclarator", "g"), (2, "FunctionExpression", "anon", {"location": location(1)}), (3, "CFG_F_START", "2_anon"),
        (4, "VariableDeclarator", "v1", {"function_context": 3}), (5, "CallExpression", None, {"location": location(2)}), (6, "PDG_OBJECT", "3.x-o1"), (7, "TAINT_SOURCE", "TAINT_SOURCE"),
        (8, "TAINT_SINK", "eval"), (9, "PDG_CALL", "3.CALL->eval-o2"), (10, "PDG_OBJECT", "3.v1-o3"), (11, "PDG_OBJECT", "0.g-o4"), (12, "PDG_OBJECT", "0.module-o5"), (13, "PDG_OBJECT", "0.module.exports-o6"),
    ]
    edges = [
        (1, 2, "AST", "init", None), (1, 3, "FD", "FD", None), (3, 4, "CFG", None, None), (4, 5, "AST", "init", None), (1, 6, "REF", "param", None, {"param_index": 0}),
        (6, 8, "PDG", "DEP", "x"), (4, 8, "SINK", "SINK", "eval"), (4, 9, "REF", "obj", None), (1, 9, "REF", "call", None), (6, 9, "PDG", "ARG", "undefined"), (9, 10, "PDG", "RET", None), (4, 10, "REF", "obj", None),
        (1, 11, "REF", "obj", None), (11, 13, "PDG", "DEP", None), (12, 13, "PDG", "SO", "exports"),
    ]
    return nodes, edges + [(7, 6, "PDG", "TAINT", None)] * exported


def call_chain(returns=True):
    """function h(y) { return y }  function f(x) { const v = h(x); eval(v) }, f's x tainted; without a return nothing flows."""
    nodes = [
        (1, "VariableDeclarator", "f"), (2, "FunctionExpression", "anon", {"location": location(5)}), (3, "CFG_F_START", "f"), (4, "PDG_OBJECT", "3.x-o1"), (5, "PDG_CALL", "3.CALL->h-o2"), (6, "PDG_OBJECT", "3.v-o3"),
        (7, "VariableDeclarator", "v", {"function_context": 3}), (8, "VariableDeclarator", "w", {"function_context": 3}), (9, "CallExpression", None, {"location": location(7)}), (10, "TAINT_SINK", "eval"),
        (21, "VariableDeclarator", "h"), (22, "FunctionExpression", "anon", {"location": location(1)}), (24, "PDG_OBJECT", "23.y-o4"), (25, "PDG_RETURN", None), (30, "TAINT_SOURCE", "TAINT_SOURCE"),
    ]
    edges = [
        (1, 2, "AST", "init", None), (1, 3, "FD", "FD", None), (1, 4, "REF", "param", None, {"param_index": 0}), (1, 5, "REF", "call", None), (7, 5, "REF", "obj", None), (5, 21, "CG", "CG", None), (7, 21, "CG", "CG", None),
        (4, 5, "PDG", "ARG", "23.y-o4"), (5, 6, "PDG", "RET", None), (7, 6, "REF", "obj", None), (6, 10, "PDG", "DEP", "v"), (8, 10, "SINK", "SINK", "eval"), (8, 9, "AST", "init", None),
        (21, 22, "AST", "init", None), (21, 24, "REF", "param", None, {"param_index": 0}), (30, 4, "PDG", "TAINT", None), (3, 7, "CFG", None, None), (7, 8, "CFG", None, None),
    ]
    return nodes, edges + [(24, 25, "PDG", "DEP", "y")] * returns


def caller_of_sink():
    """function g(x) { eval(x) }  function f(a) { g(a) }, only f's a tainted."""
    nodes = [
        (1, "VariableDeclarator", "g"), (2, "FunctionExpression", "anon", {"location": location(1)}), (6, "PDG_OBJECT", "3.x-o1"), (8, "TAINT_SINK", "eval"), (4, "VariableDeclarator", "v1"), (5, "CallExpression", None, {"location": location(2)}),
        (11, "VariableDeclarator", "f"), (12, "FunctionExpression", "anon", {"location": location(4)}), (16, "PDG_OBJECT", "13.a-o2"), (17, "PDG_CALL", "13.CALL->g-o3"), (7, "TAINT_SOURCE", "TAINT_SOURCE"),
    ]
    edges = [
        (1, 2, "AST", "init", None), (1, 6, "REF", "param", None, {"param_index": 0}), (6, 8, "PDG", "DEP", "x"), (4, 8, "SINK", "SINK", "eval"), (4, 5, "AST", "init", None),
        (11, 12, "AST", "init", None), (11, 16, "REF", "param", None, {"param_index": 0}), (11, 17, "REF", "call", None), (17, 1, "CG", "CG", None), (16, 17, "PDG", "ARG", "3.x-o1"), (7, 16, "PDG", "TAINT", None),
    ]
    return nodes, edges


def polluted(tainted=True):
    """function f(o, x, y, z) { o[x][y] = z }."""
    nodes = [
        (1, "VariableDeclarator", "f"), (2, "FunctionExpression", "anon", {"location": location(1)}), (10, "PDG_OBJECT", "3.o-o1"), (11, "PDG_OBJECT", "3.x-o2"), (12, "PDG_OBJECT", "3.y-o3"), (13, "PDG_OBJECT", "3.z-o4"),
        (20, "PDG_OBJECT", "3.o.*-o5"), (21, "PDG_OBJECT", "3.o.*-o6"), (22, "PDG_OBJECT", "3.o.*.*-o7"), (30, "ExpressionStatement", None, {"location": location(2)}), (7, "TAINT_SOURCE", "TAINT_SOURCE"),
    ]
    edges = [(1, 2, "AST", "init", None), *((1, i, "REF", "param", None, {"param_index": i - 10}) for i in (10, 11, 12, 13))]
    edges += [(10, 20, "PDG", "SO", "*"), (11, 20, "PDG", "DEP", "x"), (20, 21, "PDG", "NV", "*"), (21, 22, "PDG", "SO", "*"), (12, 21, "PDG", "DEP", "y"), (13, 22, "PDG", "DEP", "z"), (30, 22, "REF", "obj", None), (1, 13, "REF", "obj", None)]
    return nodes, edges + [(7, i, "PDG", "TAINT", None) for i in (10, 11, 12, 13)] * tainted
