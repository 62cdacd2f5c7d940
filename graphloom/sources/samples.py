"""Small program graphs, derived by hand from short programs, as a corpus of any size.

Each program is a list of nodes (id, type, name, more) and of edges (src, dst, rel_type, relation_type, name, more);
``corpus`` makes every supplier of the tables a package that holds one of the programs, so that the rules of
``plans`` run over as many packages as there are suppliers. ``SQL`` is the same for a SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import EDGES, NODES, PropertyGraph
from ..operators.closure import stored_rows

FN, FX, OBJ, CALL, START = "VariableDeclarator", "FunctionExpression", "PDG_OBJECT", "PDG_CALL", "CFG_F_START"


def _function(i: int, name: str, line: int, context: int | None = None) -> tuple[list, list]:
    """A declarator i, its body i + 1 and its start i + 2."""
    more = {} if context is None else {"ctx": context}
    return [(i, FN, name, more), (i + 1, FX, None, {"line": line}), (i + 2, START, f"{i + 1}_anon", {})], [(i, i + 1, "AST", "init", None, {}), (i, i + 2, "FD", "FD", None, {}), (i + 1, i + 2, "FD", "FD", None, {})]


def _program(functions: list, nodes: list, edges: list) -> tuple[list, list]:
    made = [_function(*f) for f in functions]
    whole = lambda row, n: tuple(row) + ((None,) * (n - 1 - len(row)) + ({},) if not isinstance(row[-1], dict) else ())
    return [x for m in made for x in m[0]] + [whole(x, 4) for x in nodes], [x for m in made for x in m[1]] + [whole(x, 6) for x in edges]


def _sink(statement: int, context: int, name: str, sink: int, line: int) -> tuple[list, list]:
    """A statement that passes something to a sink."""
    return [(statement, FN, f"v{statement}", {"ctx": context}), (statement + 1, "CallExpression", None, {"line": line}), (sink, "TAINT_SINK", name)], [(statement, statement + 1, "AST", "init"), (statement, sink, "SINK", "SINK", name), (context, statement, "CFG")]


def _direct() -> tuple[list, list]:
    """function g(x) { eval(x) }; module.exports = g, after a version of its object."""
    n, e = _sink(14, 12, "eval", 30, 2)
    n += [(20, OBJ, "12.x-o1"), (21, CALL, "12.CALL->eval-o2"), (22, OBJ, "12.v1-o3"), (23, OBJ, "0.g-o4"), (24, OBJ, "0.module-o5"), (25, OBJ, "0.module.exports-o6"), (26, OBJ, "0.g-o7"), (99, "TAINT_SOURCE", "TAINT_SOURCE")]
    e += [(10, 20, "REF", "param", None, {"pi": 0}), (20, 30, "PDG", "DEP", "x"), (14, 21, "REF", "obj"), (10, 21, "REF", "call"), (20, 21, "PDG", "ARG", "undefined", {"ai": 1}), (21, 22, "PDG", "RET"), (14, 22, "REF", "obj"), (99, 20, "PDG", "TAINT")]
    e += [(10, 26, "REF", "obj"), (23, 26, "PDG", "NV", "k"), (23, 25, "PDG", "DEP"), (24, 25, "PDG", "SO", "exports")]
    return _program([(10, "g", 1)], n, e)


def _through(returns: bool) -> tuple[list, list]:
    """function h(y) { return y }, function f(x) { const v = h(x); eval(v) }; module.exports = f; without a return nothing flows."""
    n, e = _sink(24, 12, "eval", 40, 7)
    n += [(16, FN, "v", {"ctx": 12}), (20, OBJ, "12.x-o1"), (21, CALL, "12.CALL->h-o2"), (22, OBJ, "12.v-o3"), (60, OBJ, "52.y-o4"), (61, "PDG_RETURN"), (63, OBJ, "0.f-o9"), (64, OBJ, "0.module-o10"), (65, OBJ, "0.module.exports-o11"), (99, "TAINT_SOURCE", "TAINT_SOURCE")]
    e += [(10, 20, "REF", "param", None, {"pi": 0}), (10, 21, "REF", "call"), (16, 21, "REF", "obj"), (21, 50, "CG", "CG"), (16, 50, "CG", "CG"), (20, 21, "PDG", "ARG", "52.y-o4", {"ai": 1}), (21, 22, "PDG", "RET"), (16, 22, "REF", "obj"), (22, 40, "PDG", "DEP", "v"), (50, 60, "REF", "param", None, {"pi": 0})]
    e += [(99, 20, "PDG", "TAINT"), (12, 16, "CFG"), (10, 63, "REF", "obj"), (63, 65, "PDG", "DEP"), (64, 65, "PDG", "SO", "exports")] + [(60, 61, "PDG", "DEP", "y")] * returns
    return _program([(10, "f", 5), (50, "h", 1)], n, e)


def _caller() -> tuple[list, list]:
    """function g(x) { exec(x) }, function f(a) { g(a) }; exports.p = f; only a is tainted; g is also passed to then and to a Promise in k."""
    n, e = _sink(14, 12, "exec", 30, 2)
    n += [(20, OBJ, "12.x-o1"), (54, FN, "v2", {"ctx": 52}), (55, "CallExpression"), (56, OBJ, "52.a-o2"), (57, CALL, "52.CALL->g-o3"), (60, OBJ, "0.f-o9"), (61, OBJ, "0.exports.p-o3"), (62, OBJ, "0.exports-o2"), (63, "ExpressionStatement"), (99, "TAINT_SOURCE", "TAINT_SOURCE")]
    e += [(10, 20, "REF", "param", None, {"pi": 0}), (20, 30, "PDG", "DEP", "x"), (50, 56, "REF", "param", None, {"pi": 0}), (50, 57, "REF", "call"), (54, 57, "REF", "obj"), (57, 10, "CG", "CG"), (54, 10, "CG", "CG"), (54, 55, "AST", "init"), (52, 54, "CFG"), (56, 57, "PDG", "ARG", "12.x-o1", {"ai": 1}), (99, 56, "PDG", "TAINT")]
    e += [(50, 60, "REF", "obj"), (60, 61, "PDG", "DEP"), (62, 61, "PDG", "SO", "p"), (63, 62, "REF", "obj")]
    # function k() { const a = new Promise(g), b = q.then(g), c = each(g) }
    n += [(66, OBJ, "0.g-o20")]
    e += [(10, 66, "REF", "obj")]
    for i, kind in ((74, "NewExpression"), (80, "CallExpression"), (86, "CallExpression")):
        n += [(i, FN, f"w{i}", {"ctx": 72}), (i + 1, kind), (i + 2, CALL, f"72.CALL->c-o{i}")]
        e += [(72, i, "CFG"), (i, i + 1, "AST", "init"), (i, i + 2, "REF", "obj"), (66, i + 2, "PDG", "ARG", "undefined", {"ai": 1})]
    n += [(77, "Identifier", "Promise"), (83, "MemberExpression"), (84, "Identifier", "then"), (89, "Identifier", "g"), (90, "Identifier", "each")]
    e += [(75, 77, "AST", "callee"), (81, 83, "AST", "callee"), (83, 84, "AST", "property"), (87, 89, "AST", "arg", None, {"ai": 1}), (87, 90, "AST", "callee")]
    return _program([(10, "g", 1), (50, "f", 4), (70, "k", 8)], n, e)


def _pollution() -> tuple[list, list]:
    """const m = {}; m.p = function f(o, x, y, z) { o[x][y] = z }; module.exports = m; also (o[x] || {})[y] = z and a lookup by name."""
    n = [(20, OBJ, "12.o-o1"), (21, OBJ, "12.x-o2"), (22, OBJ, "12.y-o3"), (23, OBJ, "12.z-o4"), (24, OBJ, "12.o.*-o5"), (25, OBJ, "12.o.*-o6"), (26, OBJ, "12.o.*.*-o7"), (30, "ExpressionStatement", None, {"ctx": 12, "line": 2}), (99, "TAINT_SOURCE", "TAINT_SOURCE")]
    e = [(10, 20 + i, "REF", "param", None, {"pi": i}) for i in range(4)] + [(99, 20 + i, "PDG", "TAINT") for i in range(4)]
    e += [(20, 24, "PDG", "SO", "*"), (21, 24, "PDG", "DEP", "x"), (24, 25, "PDG", "NV", "*"), (25, 26, "PDG", "SO", "*"), (22, 25, "PDG", "DEP", "y"), (23, 26, "PDG", "DEP", "z"), (30, 26, "REF", "obj"), (12, 30, "CFG")]
    # const c = o[x] || {}; c[y] = z
    n += [(31, OBJ, "12.c-o8"), (32, OBJ, "12.c-o9"), (33, OBJ, "12.c.*-o10"), (34, "ExpressionStatement", None, {"ctx": 12, "line": 3}), (35, "AssignmentExpression"), (36, "LogicalExpression"), (37, "ExpressionStatement", None, {"ctx": 12, "line": 4})]
    e += [(24, 31, "PDG", "DEP", "t"), (31, 32, "PDG", "NV", "*"), (32, 33, "PDG", "SO", "*"), (22, 32, "PDG", "DEP", "y"), (23, 33, "PDG", "DEP", "z"), (34, 31, "REF", "obj"), (34, 35, "AST", "expression"), (35, 36, "AST", "right"), (37, 33, "REF", "obj")]
    # o.name[y] = z
    n += [(40, OBJ, "12.o.name-o11"), (41, OBJ, "12.o.name-o12"), (42, OBJ, "12.o.name.*-o13"), (43, "ExpressionStatement", None, {"ctx": 12, "line": 5})]
    e += [(20, 40, "PDG", "SO", "name"), (40, 41, "PDG", "NV", "*"), (41, 42, "PDG", "SO", "*"), (22, 41, "PDG", "DEP", "y"), (23, 42, "PDG", "DEP", "z"), (43, 42, "REF", "obj")]
    n += [(60, OBJ, "0.f-o14"), (61, OBJ, "0.m.p-o15"), (62, OBJ, "0.m-o16"), (63, OBJ, "0.m-o17"), (64, OBJ, "0.module.exports-o18"), (65, OBJ, "0.module-o19"), (66, "ExpressionStatement")]
    e += [(10, 60, "REF", "obj"), (60, 61, "PDG", "DEP"), (62, 61, "PDG", "SO", "p"), (62, 63, "PDG", "NV", "p"), (63, 64, "PDG", "DEP"), (65, 64, "PDG", "SO", "exports"), (66, 62, "REF", "obj")]
    return _program([(10, "f", 1)], n, e)


def _passed() -> tuple[list, list]:
    """function f(o, x, y, z) { const w = o[x]; g(w, y, z) }, function g(a, b, c) { a[b] = c }; module.exports.q = f."""
    n = [(20, OBJ, "12.o-o1"), (21, OBJ, "12.x-o2"), (22, OBJ, "12.y-o3"), (23, OBJ, "12.z-o4"), (24, OBJ, "12.o.*-o5"), (25, CALL, "12.CALL->g-o6"), (26, FN, "r", {"ctx": 12}), (60, OBJ, "52.a-o7"), (61, OBJ, "52.b-o8"), (62, OBJ, "52.c-o9"), (63, OBJ, "52.a-o10"), (64, OBJ, "52.a.*-o11"), (65, "ExpressionStatement", None, {"ctx": 52, "line": 6}), (99, "TAINT_SOURCE", "TAINT_SOURCE")]
    e = [(10, 20 + i, "REF", "param", None, {"pi": i}) for i in range(4)] + [(50, 60 + i, "REF", "param", None, {"pi": i}) for i in range(3)] + [(99, 20 + i, "PDG", "TAINT") for i in range(4)]
    e += [(20, 24, "PDG", "SO", "*"), (21, 24, "PDG", "DEP", "x"), (24, 25, "PDG", "ARG", "52.a-o7", {"ai": 1}), (22, 25, "PDG", "ARG", "52.b-o8", {"ai": 2}), (23, 25, "PDG", "ARG", "52.c-o9", {"ai": 3}), (10, 25, "REF", "call"), (26, 25, "REF", "obj"), (25, 50, "CG", "CG"), (12, 26, "CFG"), (52, 65, "CFG")]
    e += [(60, 63, "PDG", "NV", "*"), (63, 64, "PDG", "SO", "*"), (61, 63, "PDG", "DEP", "b"), (62, 64, "PDG", "DEP", "c"), (65, 64, "REF", "obj")]
    n += [(70, OBJ, "0.f-o12"), (71, OBJ, "0.module.exports.q-o13"), (72, OBJ, "0.module.exports-o14"), (73, OBJ, "0.module.exports-o15"), (74, OBJ, "0.module-o16"), (75, "ExpressionStatement")]
    e += [(10, 70, "REF", "obj"), (70, 71, "PDG", "DEP"), (72, 71, "PDG", "SO", "q"), (73, 72, "PDG", "NV", "q"), (74, 73, "PDG", "SO", "exports"), (75, 73, "REF", "obj")]
    return _program([(10, "f", 1), (50, "g", 5)], n, e)


def _returned() -> tuple[list, list]:
    """function f() { function g(a) { readFile(a) }; return g }; module.exports = f; and an object with a method h, returned by f2."""
    n, e = _sink(54, 52, "readFile", 80, 3)
    n += [(13, "BlockStatement"), (14, "ReturnStatement", None, {"ctx": 12}), (15, "PDG_RETURN"), (20, OBJ, "0.f-o1"), (21, OBJ, "0.module.exports-o2"), (22, OBJ, "0.module-o3"), (60, OBJ, "12.g-o4"), (61, OBJ, "52.a-o5"), (99, "TAINT_SOURCE", "TAINT_SOURCE")]
    e += [(11, 13, "AST", "block"), (13, 14, "AST", "stmt"), (14, 15, "REF", "obj"), (60, 15, "PDG", "DEP"), (10, 20, "REF", "obj"), (20, 21, "PDG", "DEP"), (22, 21, "PDG", "SO", "exports"), (50, 60, "REF", "obj"), (50, 61, "REF", "param", None, {"pi": 0}), (61, 80, "PDG", "DEP", "a"), (99, 61, "PDG", "TAINT"), (12, 14, "CFG")]
    n += [(113, "BlockStatement"), (114, "ReturnStatement", None, {"ctx": 112}), (115, "PDG_RETURN"), (120, OBJ, "102.h-o6"), (121, OBJ, "112.o.h-o7"), (122, OBJ, "112.o-o8"), (123, OBJ, "112.o-o9"), (124, FN, "o", {"ctx": 112})]
    e += [(111, 113, "AST", "block"), (113, 114, "AST", "stmt"), (114, 115, "REF", "obj"), (122, 115, "PDG", "DEP"), (100, 120, "REF", "obj"), (120, 121, "PDG", "DEP"), (122, 121, "PDG", "SO", "h"), (123, 122, "PDG", "NV", "h"), (124, 123, "REF", "obj")]
    return _program([(10, "f", 1), (50, "g", 2, 12), (100, "h", 7), (110, "f2", 6)], n, e)


def _class() -> tuple[list, list]:
    """function F() { this.q = h }, F.prototype.p = f; module.exports = F."""
    n = [(20, OBJ, "0.F-o1"), (21, OBJ, "0.F.prototype-o2"), (22, OBJ, "0.F.prototype-o3"), (23, OBJ, "0.F.prototype.p-o4"), (24, OBJ, "0.module.exports-o5"), (25, OBJ, "0.module-o6"), (26, OBJ, "12.this-o7"), (27, OBJ, "12.this-o8"), (28, OBJ, "12.this.q-o9"), (60, OBJ, "0.f-o10"), (120, OBJ, "0.h-o11"), (99, "TAINT_SOURCE", "TAINT_SOURCE")]
    e = [(10, 20, "REF", "obj"), (20, 21, "PDG", "SO", "prototype"), (21, 22, "PDG", "NV", "p"), (22, 23, "PDG", "SO", "p"), (60, 23, "PDG", "DEP"), (50, 60, "REF", "obj"), (20, 24, "PDG", "DEP"), (25, 24, "PDG", "SO", "exports")]
    e += [(10, 26, "REF", "param", None, {"this": True}), (26, 27, "PDG", "NV", "q"), (27, 28, "PDG", "SO", "q"), (120, 28, "PDG", "DEP"), (100, 120, "REF", "obj")]
    return _program([(10, "F", 1), (50, "f", 3), (100, "h", 5)], n, e)


def _types() -> tuple[list, list]:
    """function f(x, n, o, z, s, a, k, t): uses of each kind, properties and sparse numeric keys; arguments and results."""
    n = [(20 + i, OBJ, f"12.{p}-o{i}") for i, p in enumerate("xnozsakt")] + [(28, OBJ, "12.this-o8")]
    e = [(10, 20 + i, "REF", "param", None, {"pi": i}) for i in range(8)] + [(10, 28, "REF", "param", None, {"this": True}), (99, 20, "PDG", "TAINT")]
    n += [(30, OBJ, "12.o.a-o9"), (31, OBJ, "12.o.a.length-o10"), (32, OBJ, "12.k.0-o11"), (33, OBJ, "12.k.2-o12"), (34, OBJ, "12.k.10-o13"), (44, OBJ, "12.k.400000000-o30"), (45, OBJ, "12.k.3000000000-o31"), (46, OBJ, "12.a.0-o32"), (47, OBJ, "12.a.q-o33"), (35, OBJ, "12.o.b-o14"), (36, OBJ, "12.m-o15"), (37, OBJ, "12.m.c-o16"), (38, "ExpressionStatement"), (39, "AssignmentExpression"), (40, "LogicalExpression"), (41, FN, "alias", {"ctx": 12}), (99, "TAINT_SOURCE", "TAINT_SOURCE")]
    e += [(22, 30, "PDG", "SO", "a"), (30, 31, "PDG", "SO", "length"), (26, 32, "PDG", "SO", "0"), (26, 33, "PDG", "SO", "2"), (26, 34, "PDG", "SO", "10"), (26, 44, "PDG", "SO", "400000000"), (26, 45, "PDG", "SO", "3000000000"), (25, 46, "PDG", "SO", "0"), (25, 47, "PDG", "SO", "q"), (22, 35, "PDG", "SO", "b"), (23, 36, "PDG", "DEP", "z"), (36, 37, "PDG", "SO", "c"), (38, 36, "REF", "obj"), (38, 39, "AST", "expression"), (39, 40, "AST", "right"), (41, 20, "REF", "obj")]

    def use(i: int, kind: str, operator: str | None, name: str, role: str, position: int | None = None) -> None:
        n.extend([(i, kind, None, {"sub": operator} if operator else {}), (i + 1, "Identifier", name)])
        e.append((i, i + 1, "AST", role, None, {} if position is None else {"ai": position}))

    def child(i: int, j: int, role: str, kind: str, name: str | None = None, **more: str) -> None:
        n.append((j, kind, name, more))
        e.append((i, j, "AST", role))

    use(200, "BinaryExpression", "+", "alias", "left")
    child(200, 202, "right", "Literal", sub="string", raw="'s'")
    use(210, "BinaryExpression", "*", "n", "left")
    child(210, 212, "right", "Literal", sub="number", raw="2")
    use(220, "BinaryExpression", "===", "z", "left")
    child(220, 222, "right", "Literal", sub="boolean", raw="true")
    use(230, "CallExpression", None, "b", "callee")  # o.b()
    use(240, "CallExpression", None, "s", "arg", 1)  # Array.isArray(s)
    child(240, 242, "callee", "MemberExpression")
    child(242, 243, "object", "Identifier", "Array")
    use(250, "CallExpression", None, "t", "arg", 2)  # join(_, t)
    child(250, 252, "callee", "Identifier", "join")
    use(260, "UnaryExpression", "typeof", "t", "argument")  # const q = typeof t; q === 'object'
    n.append((262, FN, "q", {"ctx": 12}))
    e.append((262, 260, "AST", "init"))
    use(264, "BinaryExpression", "===", "q", "left")
    child(264, 266, "right", "Literal", sub="string", raw="'object'")
    use(270, "MemberExpression", None, "a", "object")  # a.map()
    child(270, 272, "property", "Identifier", "map")
    n.append((273, "CallExpression"))
    e.append((273, 270, "AST", "callee"))
    use(280, "ForOfStatement", None, "a", "right")
    use(290, "MemberExpression", None, "s", "object")  # s.charAt()
    child(290, 292, "property", "Identifier", "charAt")
    n.append((293, "CallExpression"))
    e.append((293, 290, "AST", "callee"))
    use(300, "TemplateLiteral", None, "x", "expression")
    use(310, "CallExpression", None, "x", "arg", 1)  # eval(x)
    child(310, 312, "callee", "Identifier", "eval")
    use(320, "CallExpression", None, "c", "arg", 1)  # p.exec(c)
    child(320, 323, "callee", "MemberExpression")
    child(323, 324, "property", "Identifier", "exec")
    use(326, "NewExpression", None, "o", "arg", 1)  # new p.exec(o) says nothing
    child(326, 328, "callee", "MemberExpression")
    child(328, 329, "property", "Identifier", "exec")
    use(330, "MemberExpression", "computed", "n", "property")
    # arguments[0] -> u(arguments[0]); w = u(x)
    n += [(340, OBJ, "12.arguments-o20"), (341, OBJ, "12.arguments.*-o21"), (342, CALL, "12.CALL->u-o22"), (343, OBJ, "12.w-o23"), (360, OBJ, "352.b-o24"), (361, OBJ, "352.b-o25")]
    e += [(340, 341, "PDG", "SO", "*"), (341, 342, "PDG", "ARG", "352.b-o24", {"ai": 1}), (20, 342, "PDG", "ARG", "undefined", {"ai": 2}), (342, 343, "PDG", "RET"), (342, 350, "CG", "CG"), (350, 360, "REF", "param", None, {"pi": 0}), (360, 361, "PDG", "DEP", "b")]
    return _program([(10, "f", 1), (350, "u", 20)], n, e)


def _cycle() -> tuple[list, list]:
    """function f(a) { g(a) }, function g(b) { f(b); eval(b over 40 assignments) }, called as g(1) at the top."""
    n, e = _sink(64, 52, "eval", 40, 8)
    n += [(20, OBJ, "12.a-o1"), (21, CALL, "12.CALL->g-o2"), (22, FN, "r1", {"ctx": 12}), (60, OBJ, "52.b-o3"), (61, CALL, "52.CALL->f-o4"), (62, FN, "r2", {"ctx": 52}), (99, "TAINT_SOURCE", "TAINT_SOURCE"), *((200 + k, OBJ, f"52.c{k}-o{k}") for k in range(40))]
    e += [(10, 20, "REF", "param", None, {"pi": 0}), (50, 60, "REF", "param", None, {"pi": 0}), (10, 21, "REF", "call"), (22, 21, "REF", "obj"), (21, 50, "CG", "CG"), (22, 50, "CG", "CG"), (50, 61, "REF", "call"), (62, 61, "REF", "obj"), (61, 10, "CG", "CG"), (62, 10, "CG", "CG"), (20, 21, "PDG", "ARG", "52.b-o3", {"ai": 1}), (60, 61, "PDG", "ARG", "12.a-o1", {"ai": 1}), (99, 20, "PDG", "TAINT")]
    e += [(60, 200, "PDG", "DEP", "b"), *((200 + k, 201 + k, "PDG", "DEP", f"c{k}") for k in range(39)), (239, 40, "PDG", "DEP", "c39"), (12, 22, "CFG"), (52, 62, "CFG"), (62, 64, "CFG")]
    n += [(80, START, "__main__"), (81, FN, "r3", {"ctx": 80}), (82, "CallExpression"), (83, "Identifier", "g"), (84, CALL, "0.CALL->g-o90", {"ctx": 80})]
    e += [(80, 81, "CFG"), (81, 82, "AST", "init"), (82, 83, "AST", "callee"), (81, 84, "REF", "obj"), (84, 50, "CG", "CG"), (81, 50, "CG", "CG")]
    return _program([(10, "f", 1, 80), (50, "g", 4, 80)], n, e)


def _branches() -> tuple[list, list]:
    """function f() { let x, y; while (..) { if (..) x = 1; else y = 2; } let z }."""
    n, e = [], []
    for i, name in ((14, "x"), (16, "y"), (32, "z")):
        n.append((i, FN, name, {"ctx": 12}))
    for i, name in ((22, "x"), (26, "y")):
        n += [(i, "ExpressionStatement", None, {"ctx": 12}), (i + 1, "AssignmentExpression"), (i + 2, "Identifier", name)]
        e += [(i, i + 1, "AST", "expression"), (i + 1, i + 2, "AST", "left")]
    n += [(18, "WhileStatement", None, {"ctx": 12}), (20, "IfStatement", None, {"ctx": 12}), (30, "CFG_IF_END")]
    e += [(a, b, "CFG") for a, b in ((12, 14), (14, 16), (16, 18), (18, 20), (20, 22), (22, 30), (20, 26), (26, 30), (30, 18), (18, 32))]
    return _program([(10, "f", 1)], n, e)


def _objects() -> tuple[list, list]:
    """const a = {}, b = {}; a.p = b; const c = a; c.p.q = {}; const d = b.q; const e = a[k]; e['r'] = d; const g = b.r; let h; h = g; g.s = a; const i = h.s.p."""
    n, e = [], []

    def node(kind: str, name: str | None = None, more: dict | None = None, **children: int) -> int:
        i = 400 + len(n)
        n.append((i, kind, name, more or {}))
        e.extend((i, child, "AST", role) for role, child in children.items())
        return i

    word = lambda name: node("Identifier", name)
    member = lambda owner, name: node("MemberExpression", object=owner, property=word(name))
    declare = lambda name, value: node(FN, name, init=value)
    assign = lambda left, right: node("AssignmentExpression", left=left, right=right)
    declare("a", node("ObjectExpression"))
    declare("b", node("ObjectExpression"))
    assign(member(word("a"), "p"), word("b"))
    declare("c", word("a"))
    assign(member(member(word("c"), "p"), "q"), node("ObjectExpression"))
    declare("d", member(word("b"), "q"))
    declare("e", node("MemberExpression", None, {"sub": "computed"}, object=word("a"), property=word("k")))
    assign(node("MemberExpression", None, {"sub": "computed"}, object=word("e"), property=node("Literal", None, {"raw": "'r'"})), word("d"))
    declare("g", member(word("b"), "r"))
    node(FN, "h")
    assign(word("h"), word("g"))
    assign(member(word("g"), "s"), word("a"))
    declare("i", member(member(word("h"), "s"), "p"))
    return _program([], n, e)


def _beside(one: tuple[list, list], other: tuple[list, list]) -> tuple[list, list]:
    """Two programs in one package; the ids of the other are 1000 more."""
    more = lambda m: {**m, "ctx": m["ctx"] + 1000} if "ctx" in m else m
    return one[0] + [(i + 1000, t, name, more(m)) for i, t, name, m in other[0]], one[1] + [(x + 1000, y + 1000, *rest) for x, y, *rest in other[1]]


PROGRAMS = [_direct(), _through(True), _through(False), _caller(), _beside(_pollution(), _objects()), _passed(), _returned(), _beside(_class(), _branches()), _types(), _cycle()]

#: Classes of sinks: class, sink, place in the list.
SINKS = [("code-injection", "eval", 0), ("command-injection", "exec", 1000), ("path-traversal", "readFile", 2000), ("path-traversal", "exec", 2001)]
SIGNATURES = [("join", ["string", "number"], False)]
PROTOTYPES = [("array", "map"), ("string", "charAt")]


def config(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "sinks": spark.createDataFrame(SINKS, "vuln_type string, sink string, ord int"),
        "signatures": spark.createDataFrame(SIGNATURES, "fn string, args_types array<string>, rest boolean"),
        "prototypes": spark.createDataFrame(PROTOTYPES, "kind string, method string"),
    }


def corpus(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """A package for each supplier, named by its key. The programs are a few hundred rows, whatever the tables hold, and so are broadcast."""
    owners = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey is not null").select(F.col("s_suppkey").cast("string").alias("package_id"), (F.col("s_suppkey") % len(PROGRAMS)).cast("int").alias("program"))

    # the suppliers are few bytes, so read by one task, and what it makes of them would be one file for every scan to come
    owners = owners.repartition(spark.sparkContext.defaultParallelism, "package_id")

    def table(rows: list, schema: str, *order: str) -> DataFrame:
        names = [f.name for f in StructType.fromDDL(schema)]
        few = spark.createDataFrame([{"program": p, **{k: v for k, v in r.items() if k in names}} for p, r in rows], f"program int, {schema}")
        return stored_rows(owners.join(F.broadcast(few.withColumnRenamed("package_id", "none").drop("none")), "program").select(*names), *order)

    place = lambda line: None if line is None else {"start": {"line": line, "column": 0}, "end": {"line": line, "column": 1}, "fname": "main.js"}
    nodes = [(p, {"node_id": i, "type": t, "identifier_name": name, "function_context": m.get("ctx"), "sub_type": m.get("sub"), "raw": m.get("raw"), "location": place(m.get("line"))}) for p, (rows, _) in enumerate(PROGRAMS) for i, t, name, m in rows]
    edges = [(p, {"edge_id": k, "src": a, "dst": b, "rel_type": rel, "relation_type": relation, "identifier_name": name, "param_index": m.get("pi"), "argument_index": m.get("ai"), "is_this": m.get("this")}) for p, (_, rows) in enumerate(PROGRAMS) for k, (a, b, rel, relation, name, m) in enumerate(rows)]
    return PropertyGraph(table(nodes, NODES, "type"), table(edges, EDGES, "rel_type", "relation_type", "identifier_name"))


def _values(rows: list[tuple]) -> str:
    one = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, bool)) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


#: Tables n and e of all programs (v: program), for a SQL engine.
SQL = (
    "n(v, id, type, name, ctx, sub, raw, line) AS ("
    + _values([(p, i, t, name, m.get("ctx"), m.get("sub"), m.get("raw"), m.get("line")) for p, (rows, _) in enumerate(PROGRAMS) for i, t, name, m in rows])
    + "), e(v, k, s, d, rel, r, name, pi, ai, this) AS ("
    + _values([(p, k, a, b, rel, relation, name, m.get("pi"), m.get("ai"), m.get("this")) for p, (_, rows) in enumerate(PROGRAMS) for k, (a, b, rel, relation, name, m) in enumerate(rows)])
    + ")"
)
