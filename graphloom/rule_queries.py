"""Queries of the program-graph rules over the corpus of ``sources.samples``, with their SQL.

Each applies one rule of ``plans`` to all packages. The SQL states the rule once more, over all programs, and gives
each supplier its program's rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import PropertyGraph
from .operators.match import start
from .plans import detect, flow, packages, param_types, protocol
from .sources import samples
from .sources.graph_files import source_lines
from .sources.samples import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_COMMON = f"""WITH RECURSIVE {samples.SQL},
sinks(vuln_type, sink, ord) AS (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in samples.SINKS)}),
pdg AS (SELECT * FROM e WHERE rel = 'PDG'), dep AS (SELECT * FROM pdg WHERE r = 'DEP'), so AS (SELECT * FROM pdg WHERE r = 'SO'), nv AS (SELECT * FROM pdg WHERE r = 'NV'),
ast AS (SELECT * FROM e WHERE rel = 'AST'), cgr AS (SELECT * FROM e WHERE rel = 'CG'), ref AS (SELECT * FROM e WHERE rel = 'REF'), fd AS (SELECT * FROM e WHERE rel = 'FD'),
obj AS (SELECT v, id, name FROM n WHERE type = 'PDG_OBJECT'), fn AS (SELECT v, id, name, ctx FROM n WHERE type = 'VariableDeclarator'), cal AS (SELECT v, id, ctx FROM n WHERE type = 'PDG_CALL'),
ids AS (SELECT v, id AS a, id AS b FROM n),
pdg_r AS (SELECT * FROM ids UNION SELECT w.v, w.a, x.d FROM pdg_r w JOIN pdg x ON x.v = w.v AND x.s = w.b),
nv_t AS (SELECT v, s AS a, d AS b FROM nv UNION SELECT w.v, w.a, x.d FROM nv_t w JOIN nv x ON x.v = w.v AND x.s = w.b),
nv_r AS (SELECT * FROM ids UNION SELECT * FROM nv_t),
ast_r AS (SELECT * FROM ids UNION SELECT w.v, w.a, x.d FROM ast_r w JOIN ast x ON x.v = w.v AND x.s = w.b),
cfg AS (SELECT v, s, d FROM e WHERE rel = 'CFG'), cfg_t AS (SELECT v, s AS a, d AS b FROM cfg UNION SELECT w.v, w.a, x.d FROM cfg_t w JOIN cfg x ON x.v = w.v AND x.s = w.b),
taint AS (SELECT t.v, t.d AS node, n.type = 'TAINT_SOURCE' AS source FROM pdg t JOIN obj o ON o.v = t.v AND o.id = t.d JOIN n ON n.v = t.v AND n.id = t.s WHERE t.r = 'TAINT'),
exported AS (SELECT DISTINCT v, node FROM taint WHERE source),
cg AS (SELECT DISTINCT f.v, f.id AS func, c.id AS call, g.id AS callee FROM fn f JOIN ref ON ref.v = f.v AND ref.s = f.id AND ref.r = 'call' JOIN cal c ON c.v = f.v AND c.id = ref.d JOIN cgr ON cgr.v = f.v AND cgr.s = c.id JOIN fn g ON g.v = f.v AND g.id = cgr.d
  WHERE EXISTS (SELECT 1 FROM ast JOIN n ON n.v = ast.v AND n.id = ast.d WHERE ast.v = f.v AND ast.s = f.id AND n.type = 'FunctionExpression')),
vseed AS (SELECT a.v, a.k, a.s, a.d FROM pdg a JOIN obj o ON o.v = a.v AND o.id = a.s JOIN cal c ON c.v = a.v AND c.id = a.d WHERE a.name IN ('this', 'undefined')),
args AS (SELECT a.v, a.k, a.s, a.d, g.id AS func, p.id AS param FROM pdg a JOIN obj o ON o.v = a.v AND o.id = a.s JOIN cal c ON c.v = a.v AND c.id = a.d JOIN cgr ON cgr.v = a.v AND cgr.s = a.d JOIN fn g ON g.v = a.v AND g.id = cgr.d JOIN ref ON ref.v = a.v AND ref.s = g.id JOIN obj p ON p.v = a.v AND p.id = ref.d AND p.name = a.name),
known AS (SELECT v, func FROM cg UNION SELECT v, callee FROM cg), cand AS (SELECT DISTINCT args.* FROM args JOIN known USING (v, func)),
free AS (SELECT v, s, d FROM pdg WHERE r IS DISTINCT FROM 'ARG'), ret AS (SELECT v, id FROM n WHERE type = 'PDG_RETURN'),
flow0 AS (SELECT * FROM free UNION SELECT v, s, d FROM vseed), back0 AS (SELECT f.v, f.s AS node FROM flow0 f JOIN ret ON ret.v = f.v AND ret.id = f.d UNION SELECT f.v, f.s FROM back0 b JOIN flow0 f ON f.v = b.v AND f.d = b.node),
valid1 AS (SELECT * FROM vseed UNION SELECT c.v, c.k, c.s, c.d FROM cand c JOIN back0 b ON b.v = c.v AND b.node = c.param),
flow1 AS (SELECT * FROM free UNION SELECT v, s, d FROM valid1), back1 AS (SELECT f.v, f.s AS node FROM flow1 f JOIN ret ON ret.v = f.v AND ret.id = f.d UNION SELECT f.v, f.s FROM back1 b JOIN flow1 f ON f.v = b.v AND f.d = b.node),
valid AS (SELECT * FROM vseed UNION SELECT c.v, c.k, c.s, c.d FROM cand c JOIN back1 b ON b.v = c.v AND b.node = c.param),
flow AS (SELECT * FROM free UNION SELECT v, s, d FROM valid), flow_t AS (SELECT v, s AS a, d AS b FROM flow UNION SELECT w.v, w.a, x.d FROM flow_t w JOIN flow x ON x.v = w.v AND x.s = w.b), flow_r AS (SELECT * FROM ids UNION SELECT * FROM flow_t),
steps AS (SELECT DISTINCT c.v, own.id AS src, p.id AS dst FROM cg c JOIN ref rp ON rp.v = c.v AND rp.s = c.callee JOIN obj p ON p.v = c.v AND p.id = rp.d JOIN ref rc ON rc.v = c.v AND rc.s = c.func AND rc.r = 'call' JOIN cgr ON cgr.v = c.v AND cgr.s = rc.d JOIN fn called ON called.v = c.v AND called.id = cgr.d
  JOIN pdg a ON a.v = c.v AND a.d = rc.d AND a.name = p.name JOIN pdg l ON l.v = c.v AND l.d = rc.d JOIN flow_r w ON w.v = c.v AND w.b = l.s JOIN ref ro ON ro.v = c.v AND ro.s = c.func AND ro.d = w.a JOIN obj own ON own.v = c.v AND own.id = w.a),
confirmed AS (SELECT * FROM exported UNION SELECT x.v, x.dst FROM confirmed w JOIN steps x ON x.v = w.v AND x.src = w.node),
declared AS (SELECT DISTINCT f.v, o.id AS node FROM fn f JOIN ref ON ref.v = f.v AND ref.s = f.id AND ref.r = 'param' JOIN obj o ON o.v = f.v AND o.id = ref.d),
place AS (SELECT DISTINCT k.v, k.d AS sink, k.s AS sink_function, y.line AS sink_lineno, t.vuln_type FROM e k JOIN n z ON z.v = k.v AND z.id = k.d JOIN ast ON ast.v = k.v AND ast.s = k.s JOIN n y ON y.v = k.v AND y.id = ast.d LEFT JOIN (SELECT sink, arg_min(vuln_type, ord) AS vuln_type FROM sinks GROUP BY 1) t ON t.sink = z.name WHERE k.rel = 'SINK'),
pe AS (SELECT DISTINCT v, s, param AS d FROM args), pe_t AS (SELECT v, s AS a, d AS b FROM pe UNION SELECT w.v, w.a, x.d FROM pe_t w JOIN pe x ON x.v = w.v AND x.s = w.b),
wr AS (SELECT a.v, a.s AS source, a.d AS version, b.d AS property FROM nv a JOIN so b ON b.v = a.v AND b.s = a.d AND b.name = '*' JOIN obj x ON x.v = a.v AND x.id = a.d JOIN obj y ON y.v = a.v AND y.id = b.d WHERE a.name = '*'),
lk AS (SELECT a.v, a.s AS obj, a.d AS sub, a.name FROM so a JOIN obj x ON x.v = a.v AND x.id = a.s JOIN obj y ON y.v = a.v AND y.id = a.d),
dob AS (SELECT a.v, a.s, a.d FROM dep a JOIN obj o ON o.v = a.v AND o.id = a.s),
pin AS (SELECT lk.v, lk.obj, lk.sub, wr.version, wr.property FROM lk JOIN wr ON wr.v = lk.v AND wr.source = lk.sub WHERE lk.name = '*' UNION SELECT lk.v, lk.obj, lk.sub, wr.version, wr.property FROM lk JOIN pe_t w ON w.v = lk.v AND w.a = lk.sub JOIN wr ON wr.v = lk.v AND wr.source = w.b WHERE lk.name = '*'),
lks AS (SELECT lk.v, lk.obj, lk.sub, p1.s AS property1 FROM lk JOIN dob p1 ON p1.v = lk.v AND p1.d = lk.sub WHERE lk.name = '*'),
logic AS (SELECT DISTINCT o.v, o.d AS choice FROM ref o JOIN n st ON st.v = o.v AND st.id = o.s AND st.type = 'ExpressionStatement' JOIN ast a ON a.v = o.v AND a.s = o.s AND a.r = 'expression' JOIN n x ON x.v = o.v AND x.id = a.d AND x.type = 'AssignmentExpression' JOIN ast b ON b.v = o.v AND b.s = a.d AND b.r = 'right' JOIN n y ON y.v = o.v AND y.id = b.d AND y.type = 'LogicalExpression' WHERE o.r = 'obj'),
ways AS (SELECT v, obj, property1, sub AS source FROM lks UNION SELECT lks.v, obj, property1, w.b FROM lks JOIN pe_t w ON w.v = lks.v AND w.a = lks.sub UNION SELECT lks.v, obj, property1, c.d FROM lks JOIN dep c ON c.v = lks.v AND c.s = lks.sub JOIN logic l ON l.v = c.v AND l.choice = c.d UNION SELECT v, obj, obj, sub FROM lk),
pat AS (SELECT DISTINCT ways.v, obj, property1, p2.s AS property2, val.s AS value, wr.property FROM ways JOIN wr ON wr.v = ways.v AND wr.source = ways.source JOIN dob p2 ON p2.v = ways.v AND p2.d = wr.version JOIN dob val ON val.v = ways.v AND val.d = wr.property),
stm AS (SELECT v, d AS property, min(s) AS statement FROM ref GROUP BY 1, 2),
own AS (SELECT DISTINCT f.v, f.s AS func, f.d AS context FROM fd f WHERE EXISTS (SELECT 1 FROM ast WHERE ast.v = f.v AND ast.s = f.s AND ast.r = 'init')),
parent AS (SELECT own.v, own.func, n.id AS statement FROM own JOIN n ON n.v = own.v AND n.ctx = own.context UNION SELECT own.v, own.func, w.b FROM own JOIN cfg_t w ON w.v = own.v AND w.a = own.context JOIN n ON n.v = w.v AND n.id = w.b AND n.ctx IS NULL),
prop AS (SELECT r0.v, r0.s AS fn, f.name AS fn_name, b.name AS prop_name, o.id AS obj, o.name AS obj_name FROM ref r0 JOIN obj f ON f.v = r0.v AND f.id = r0.d JOIN dep a ON a.v = r0.v AND a.s = f.id JOIN obj sub ON sub.v = r0.v AND sub.id = a.d JOIN so b ON b.v = r0.v AND b.d = sub.id JOIN obj o ON o.v = r0.v AND o.id = b.s WHERE r0.r = 'obj'),
hold AS (SELECT a.v, a.d AS x, a.k FROM pdg a JOIN obj h ON h.v = a.v AND h.id = a.s JOIN obj x ON x.v = a.v AND x.id = a.d WHERE a.name = 'exports' AND contains(h.name, 'module')),
slot AS (SELECT DISTINCT v, d AS x FROM so WHERE name = 'exports'),
orig AS (SELECT DISTINCT w.v, w.b AS obj, ref.s AS source, EXISTS (SELECT 1 FROM fd JOIN n ON n.v = fd.v AND n.id = fd.d AND n.type = 'CFG_F_START' WHERE fd.v = w.v AND fd.s = ref.s) AS is_function FROM pdg_r w JOIN obj o ON o.v = w.v AND o.id = w.a JOIN ref ON ref.v = w.v AND ref.d = w.a AND ref.r = 'obj'),
b0 AS (SELECT r0.v, r0.s AS fn, 'Call::' || f.name || ':' || r0.s AS path FROM ref r0 JOIN obj f ON f.v = r0.v AND f.id = r0.d LEFT JOIN nv_t w ON w.v = r0.v AND w.b = f.id JOIN dep a ON a.v = r0.v AND a.s = coalesce(w.a, f.id) JOIN so b ON b.v = r0.v AND b.d = a.d AND b.name = 'exports' JOIN obj m ON m.v = r0.v AND m.id = b.s AND contains(m.name, 'module') WHERE r0.r = 'obj'),
by1 AS (SELECT p.*, o.source, o.is_function FROM prop p JOIN orig o ON o.v = p.v AND o.obj = p.obj WHERE contains(p.obj_name, 'exports')),
loose AS (SELECT DISTINCT p.* FROM prop p JOIN pdg_r w ON w.v = p.v AND w.a = p.obj JOIN obj l ON l.v = p.v AND l.id = w.b JOIN pdg d0 ON d0.v = p.v AND d0.s = w.b JOIN hold h ON h.v = p.v AND h.x = d0.d AND h.k <> d0.k),
nested AS (SELECT DISTINCT p.* FROM prop p JOIN nv_r w ON w.v = p.v AND w.a = p.obj JOIN obj l ON l.v = p.v AND l.id = w.b JOIN dep d0 ON d0.v = p.v AND d0.s = w.b JOIN obj i ON i.v = p.v AND i.id = d0.d JOIN so b ON b.v = p.v AND b.d = i.id JOIN obj o ON o.v = p.v AND o.id = b.s JOIN nv_r u ON u.v = p.v AND u.a = o.id JOIN dep d1 ON d1.v = p.v AND d1.s = u.b JOIN hold h ON h.v = p.v AND h.x = d1.d JOIN slot ON slot.v = p.v AND slot.x = d1.d),
by2 AS (SELECT q.*, o.source, o.is_function FROM (SELECT * FROM loose UNION SELECT * FROM nested) q JOIN orig o ON o.v = q.v AND o.obj = q.obj),
mp1 AS (SELECT p.* FROM prop p JOIN pdg d0 ON d0.v = p.v AND d0.d = p.obj JOIN hold h ON h.v = p.v AND h.x = d0.s UNION SELECT p.* FROM prop p JOIN dep d0 ON d0.v = p.v AND d0.s = p.obj JOIN obj i ON i.v = p.v AND i.id = d0.d JOIN so b ON b.v = p.v AND b.d = i.id JOIN obj o ON o.v = p.v AND o.id = b.s JOIN nv_t w ON w.v = p.v AND w.b = o.id JOIN hold h ON h.v = p.v AND h.x = w.a),
mp2 AS (SELECT DISTINCT p.* FROM prop p JOIN nv_t w ON w.v = p.v AND w.b = p.obj JOIN obj f ON f.v = p.v AND f.id = w.a JOIN dep d0 ON d0.v = p.v AND d0.s = w.a JOIN hold h ON h.v = p.v AND h.x = d0.d JOIN slot ON slot.v = p.v AND slot.x = d0.d),
by3 AS (SELECT q.*, o.source, o.is_function FROM mp1 q JOIN orig o ON o.v = q.v AND o.obj = q.obj UNION SELECT q.*, o.source, false FROM mp2 q JOIN orig o ON o.v = q.v AND o.obj = q.obj),
pr1 AS (SELECT p.*, x.s AS proto FROM prop p JOIN nv x ON x.v = p.v AND x.d = p.obj), own1 AS (SELECT p.*, d0.k, d0.d AS x FROM pr1 p JOIN so b ON b.v = p.v AND b.d = p.proto JOIN obj o ON o.v = p.v AND o.id = b.s JOIN pdg d0 ON d0.v = p.v AND d0.s = o.id JOIN obj x0 ON x0.v = p.v AND x0.id = d0.d),
pr2 AS (SELECT p.*, w.a AS proto FROM prop p JOIN nv_r w ON w.v = p.v AND w.b = p.obj), own2 AS (SELECT p.*, d0.k, d0.d AS x FROM pr2 p JOIN so b ON b.v = p.v AND b.d = p.proto JOIN obj o ON o.v = p.v AND o.id = b.s JOIN pdg d0 ON d0.v = p.v AND d0.s = o.id JOIN obj x0 ON x0.v = p.v AND x0.id = d0.d),
protos AS (SELECT o.v, fn, fn_name, prop_name, obj, obj_name, NULL::VARCHAR AS export_name FROM own1 o JOIN hold h ON h.v = o.v AND h.x = o.x AND h.k <> o.k
  UNION SELECT o.v, fn, fn_name, prop_name, obj, obj_name, b.name FROM own1 o JOIN so b ON b.v = o.v AND b.d = o.x JOIN obj sl ON sl.v = o.v AND sl.id = b.s JOIN nv m ON m.v = o.v AND m.d = sl.id JOIN hold h ON h.v = o.v AND h.x = m.s
  UNION SELECT o.v, fn, fn_name, prop_name, obj, obj_name, b.name FROM own2 o JOIN so b ON b.v = o.v AND b.d = o.x JOIN obj sl ON sl.v = o.v AND sl.id = b.s JOIN nv_r w ON w.v = o.v AND w.b = sl.id JOIN obj eo ON eo.v = o.v AND eo.id = w.a AND contains(eo.name, 'exports')),
by4 AS (SELECT q.*, o.source, o.is_function FROM protos q JOIN orig o ON o.v = q.v AND o.obj = q.obj WHERE o.is_function),
by5 AS (SELECT DISTINCT p.v, p.fn, p.fn_name, p.prop_name, c.name AS obj_name, t.s AS source FROM prop p JOIN nv_t w ON w.v = p.v AND w.b = p.obj JOIN ref t ON t.v = p.v AND t.d = w.a AND t.r = 'param' AND t.this JOIN ref ro ON ro.v = p.v AND ro.s = t.s AND ro.r = 'obj' JOIN obj c ON c.v = p.v AND c.id = ro.d JOIN pdg d0 ON d0.v = p.v AND d0.s = c.id JOIN hold h ON h.v = p.v AND h.x = d0.d AND h.k <> d0.k),
m1 AS (SELECT DISTINCT v, fn, CASE WHEN is_function THEN 'New::' || obj_name || ':' || source || '>' ELSE '' END || 'Method:' || prop_name || ':' || fn_name || ':' || fn AS path FROM by1),
m2 AS (SELECT DISTINCT v, fn, CASE WHEN is_function THEN 'New::' || obj_name || ':' || source || '>' ELSE '' END || 'Method:' || prop_name || ':' || fn_name || ':' || fn AS path FROM by2),
m3 AS (SELECT DISTINCT v, fn, CASE WHEN is_function THEN 'New::' || obj_name || ':' || source || '>' ELSE '' END || 'Method:' || prop_name || ':' || fn_name || ':' || fn AS path FROM by3),
m4 AS (SELECT DISTINCT v, fn, 'New:' || coalesce(export_name, '') || ':' || obj_name || ':' || source || '>Method:' || prop_name || ':' || fn_name || ':' || fn AS path FROM by4),
m5 AS (SELECT DISTINCT v, fn, 'New::' || obj_name || ':' || source || '>Method:' || prop_name || ':' || fn_name || ':' || fn AS path FROM by5),
exps AS (SELECT *, 0 AS b FROM b0 UNION SELECT *, 1 FROM m1 UNION SELECT *, 2 FROM m2 UNION SELECT *, 3 FROM m3 UNION SELECT *, 4 FROM m4 UNION SELECT *, 5 FROM m5),
types AS (SELECT v, fn, arg_min(path, (b, path)) AS path FROM exps GROUP BY 1, 2),
encl AS (SELECT DISTINCT a.v, a.s AS obj, i.s AS source_fn FROM dep a JOIN ret ON ret.v = a.v AND ret.id = a.d JOIN ref ON ref.v = a.v AND ref.d = a.d JOIN ast_r w ON w.v = a.v AND w.b = ref.s JOIN n x ON x.v = a.v AND x.id = w.a AND x.type = 'FunctionExpression' JOIN ast i ON i.v = a.v AND i.d = w.a AND i.r = 'init' JOIN fn f ON f.v = a.v AND f.id = i.s),
rets AS (SELECT r0.v, r0.s AS fn, q.source_fn, 'Call::' || o.name || ':' || r0.s AS step FROM ref r0 JOIN obj o ON o.v = r0.v AND o.id = r0.d JOIN encl q ON q.v = r0.v AND q.obj = o.id WHERE r0.r = 'obj'
  UNION SELECT p.v, p.fn, q.source_fn, CASE WHEN EXISTS (SELECT 1 FROM dep c JOIN nv_t w ON w.v = c.v AND w.a = c.d JOIN so ic ON ic.v = c.v AND ic.s = w.b AND ic.name = 'is_class' WHERE c.v = p.v AND c.s = q.source_fn) THEN 'New:' ELSE 'Method:' END || p.prop_name || ':' || p.fn_name || ':' || p.fn FROM prop p JOIN encl q ON q.v = p.v AND q.obj = p.obj JOIN nv x ON x.v = p.v AND x.d = p.obj JOIN obj po ON po.v = p.v AND po.id = x.s
    WHERE EXISTS (SELECT 1 FROM pdg_r w JOIN ref ON ref.v = w.v AND ref.d = w.a AND ref.r = 'obj' WHERE w.v = p.v AND w.b = x.s)),
passed AS (SELECT r0.v, r0.s AS fn, st.s AS statement FROM ref r0 JOIN obj o ON o.v = r0.v AND o.id = r0.d JOIN pdg a ON a.v = r0.v AND a.s = o.id AND a.r = 'ARG' JOIN cal c ON c.v = r0.v AND c.id = a.d JOIN ref st ON st.v = r0.v AND st.d = c.id AND st.r = 'obj' WHERE r0.r = 'obj'),
calls AS (SELECT g.v, g.d AS fn, p.func AS caller FROM cgr g JOIN parent p ON p.v = g.v AND p.statement = g.s UNION SELECT q.v, q.fn, p.func FROM passed q JOIN parent p USING (v, statement)
  UNION SELECT p.v, g.d, p.func FROM parent p JOIN fn f ON f.v = p.v AND f.id = p.statement JOIN ref ON ref.v = p.v AND ref.s = p.statement AND ref.r = 'obj' JOIN cal c ON c.v = p.v AND c.id = ref.d JOIN cgr g ON g.v = p.v AND g.s = c.id),
tops AS (SELECT DISTINCT f.v, f.id AS fn, 'TopLevel::' || f.name || ':' || f.id AS path FROM fn f JOIN n m ON m.v = f.v AND m.id = f.ctx AND m.type = 'CFG_F_START' AND m.name = '__main__' JOIN cgr g ON g.v = f.v AND g.d = f.id JOIN cal c ON c.v = f.v AND c.id = g.s AND c.ctx = m.id JOIN ref ON ref.v = f.v AND ref.d = c.id AND ref.r = 'obj' JOIN fn st ON st.v = f.v AND st.id = ref.s
  JOIN ast a ON a.v = f.v AND a.s = st.id AND a.r = 'init' JOIN n x ON x.v = f.v AND x.id = a.d AND x.type = 'CallExpression' JOIN ast b ON b.v = f.v AND b.s = x.id JOIN n y ON y.v = f.v AND y.id = b.d AND y.type = 'Identifier' AND y.name = f.name),
begins AS (SELECT * FROM types UNION ALL SELECT * FROM tops WHERE NOT EXISTS (SELECT 1 FROM types WHERE types.v = tops.v AND types.fn = tops.fn)),
ups AS (SELECT v, fn, caller AS nxt, '' AS step FROM calls WHERE fn <> caller UNION SELECT v, fn, source_fn, '>' || step FROM rets),
targets AS (SELECT DISTINCT p.v, p.func AS target FROM e k JOIN parent p ON p.v = k.v AND p.statement = k.s WHERE k.rel = 'SINK'),
walk AS (SELECT v, target, target AS fn, '' AS suffix, [target] AS seen FROM targets UNION ALL SELECT w.v, w.target, u.nxt, u.step || w.suffix, list_append(w.seen, u.nxt) FROM walk w JOIN ups u ON u.v = w.v AND u.fn = w.fn WHERE NOT list_contains(w.seen, u.nxt) AND NOT EXISTS (SELECT 1 FROM begins b WHERE b.v = w.v AND b.fn = w.fn)),
first_way AS (SELECT v, target, fn, arg_min(suffix, (len(seen), suffix)) AS suffix FROM walk GROUP BY 1, 2, 3),
way AS (SELECT DISTINCT f.v, f.target, b.path || f.suffix AS path FROM first_way f JOIN begins b ON b.v = f.v AND b.fn = f.fn)"""


def rule_sql(body: str) -> str:
    """A statement over the tables above that gives v and a query's other columns, for each supplier."""
    return f"{_COMMON}, result AS ({body}) SELECT s_suppkey::VARCHAR AS package_id, result.* EXCLUDE (v) FROM result JOIN supplier ON s_suppkey % {len(samples.PROGRAMS)} = v"


def rule(body: str, one: Callable[[SparkSession, str], DataFrame] | None = None):
    """Registers a query with its SQL, a statement over the tables above that gives v and the query's other columns."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = rule_sql(body)
        return f

    return add


def path_text(path: Column) -> Column:
    """A call path as text: type:property:name:id of each step."""
    return F.array_join(F.transform(path, lambda s: F.concat_ws(":", s["type"], F.coalesce(s["prop"], F.lit("")), s["fn_name"], s["fn_id"].cast("string"))), ">")


def _paths(found: DataFrame) -> DataFrame:
    return found.select("package_id", "fn", path_text(F.col("path")).alias("path")).distinct()


# flow ----------------------------------------------------------------------------------------


@rule("SELECT v, k AS edge_id, s AS src, d AS dst FROM vseed")
def rule_valid_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.valid_seed(corpus(spark, sf_dir))


@rule("SELECT v, func, call, callee FROM cg")
def rule_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.call_graph(corpus(spark, sf_dir))


@rule("SELECT v, callee, string_agg(DISTINCT func::VARCHAR, ',' ORDER BY func::VARCHAR) AS callers FROM cg GROUP BY 1, 2")
def rule_transposed_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flow.callers_by_callee(corpus(spark, sf_dir))
    return found.select("package_id", "callee", F.array_join(F.array_sort(F.transform("callers", lambda x: x.cast("string"))), ",").alias("callers"))


@rule("SELECT v, k AS edge_id, s AS src, d AS dst FROM valid")
def rule_valid_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least fixpoint of argument edges that taint may pass."""
    return flow.valid_arguments(corpus(spark, sf_dir))


@rule("SELECT v, node FROM exported")
def rule_exported_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.exported_params(corpus(spark, sf_dir))


@rule("SELECT v, src, dst FROM steps")
def rule_confirmation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus(spark, sf_dir)
    return flow.confirmation_steps(g, flow.passable(g))


@rule("SELECT v, node FROM confirmed")
def rule_confirmed_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.flow_of(corpus(spark, sf_dir)).confirmed


@rule("SELECT DISTINCT v, s AS src, d AS dst FROM pe")
def rule_parameter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.parameter_edges(corpus(spark, sf_dir)).distinct()


# detections ----------------------------------------------------------------------------------


def _located(found: DataFrame) -> DataFrame:
    return found.select("package_id", "vuln_type", "sink_lineno", "sink_function")


_REACH = "pdg_t AS (SELECT v, s AS a, d AS b FROM pdg UNION SELECT w.v, w.a, x.d FROM pdg_t w JOIN pdg x ON x.v = w.v AND x.s = w.b)"
_INJECTIONS = "SELECT DISTINCT place.v, place.vuln_type, place.sink_lineno, place.sink_function FROM place JOIN n z ON z.v = place.v AND z.id = place.sink AND z.type = 'TAINT_SINK' JOIN {0} w ON w.v = place.v AND w.b = place.sink WHERE w.a IN (SELECT node FROM {1} t WHERE t.v = place.v)"


@rule(f"WITH RECURSIVE {_REACH}, bodied AS (SELECT x.v, x.node FROM exported x WHERE EXISTS (SELECT 1 FROM ref JOIN ast ON ast.v = ref.v AND ast.s = ref.s WHERE ref.v = x.v AND ref.d = x.node AND ref.r = 'param')) " + _INJECTIONS.format("pdg_t", "bodied"))
def rule_injection_intra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(detect.injections(corpus(spark, sf_dir), samples.config(spark)["sinks"], query="intra"))


_INJECTION = "WITH ok AS (SELECT v, node FROM declared JOIN confirmed USING (v, node)) " + _INJECTIONS.format("flow_t", "ok")


@rule(_INJECTION)
def rule_injection_bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(detect.injections(corpus(spark, sf_dir), samples.config(spark)["sinks"]))


@rule("SELECT v, obj, sub, version, property FROM pin")
def rule_pollution_patterns_intra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.pollution_patterns_intra(corpus(spark, sf_dir))


@rule("SELECT v, obj, property1, property2, value, property FROM pat")
def rule_pollution_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.pollution_patterns(corpus(spark, sf_dir))


_STATEMENT = "LEFT JOIN stm ON stm.v = q.v AND stm.property = q.property LEFT JOIN n y ON y.v = q.v AND y.id = stm.statement"


@rule(
    """WITH RECURSIVE tp AS (SELECT v, s AS a, d AS b FROM pdg WHERE r IN ('SO', 'ARG', 'DEP')), tp_t AS (SELECT * FROM tp UNION SELECT w.v, w.a, x.b FROM tp_t w JOIN tp x ON x.v = w.v AND x.a = w.b), tp_r AS (SELECT * FROM ids UNION SELECT * FROM tp_t),
q AS (SELECT DISTINCT pin.v, pin.obj, w.a AS value, pin.property FROM pin JOIN dep ON dep.v = pin.v AND dep.d = pin.property JOIN tp_r w ON w.v = pin.v AND w.b = dep.s WHERE w.a IN (SELECT node FROM taint WHERE taint.v = pin.v) AND EXISTS (SELECT 1 FROM ref WHERE ref.v = pin.v AND ref.d = w.a)
  AND EXISTS (SELECT 1 FROM tp_t k JOIN taint ON taint.v = k.v AND taint.node = k.a AND taint.source WHERE k.v = pin.v AND k.b = pin.sub) AND EXISTS (SELECT 1 FROM tp_t k JOIN taint ON taint.v = k.v AND taint.node = k.a WHERE k.v = pin.v AND k.b = pin.version))
SELECT DISTINCT q.v, 'prototype-pollution' AS vuln_type, y.line AS sink_lineno, stm.statement AS sink_function FROM q """
    + _STATEMENT
)
def rule_pollution_intra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(detect.pollutions(corpus(spark, sf_dir), query="intra")).distinct()


_POLLUTION = (
    """WITH held AS (SELECT d.v, w.b AS node FROM declared d JOIN confirmed USING (v, node) JOIN flow_r w ON w.v = d.v AND w.a = d.node),
q AS (SELECT p.* FROM pat p WHERE (p.property1 IN (SELECT node FROM exported x WHERE x.v = p.v) AND p.property2 IN (SELECT node FROM exported x WHERE x.v = p.v) AND p.value IN (SELECT node FROM exported x WHERE x.v = p.v)) OR (p.property1 IN (SELECT node FROM held x WHERE x.v = p.v) AND p.property2 IN (SELECT node FROM held x WHERE x.v = p.v) AND p.value IN (SELECT node FROM held x WHERE x.v = p.v)))
SELECT DISTINCT q.v, 'prototype-pollution' AS vuln_type, y.line AS sink_lineno, stm.statement AS sink_function FROM q """
    + _STATEMENT
)


@rule(_POLLUTION)
def rule_pollution_bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(detect.pollutions(corpus(spark, sf_dir))).distinct()


def main_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """package_id, path, content: a file of six lines for each package."""
    text = "\n".join(f"  statement {i}" + "\r" * (i % 2) for i in range(1, 7))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey is not null").select(F.col("s_suppkey").cast("string").alias("package_id"), F.lit("main.js").alias("path"), F.lit(text).alias("content"))


@rule(f"""WITH inj AS ({_INJECTION}), pol AS ({_POLLUTION}) SELECT DISTINCT v, CASE WHEN sink_lineno IS NOT NULL THEN 'main.js' END AS filename, vuln_type, CASE WHEN sink_lineno <= 6 THEN 'statement ' || sink_lineno ELSE '' END AS sink, sink_lineno, sink_function
FROM (SELECT v, vuln_type, sink_lineno, sink_function FROM inj UNION SELECT v, vuln_type, sink_lineno, sink_function FROM pol)""")
def rule_analyse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of a corpus as a whole: every detection with its file and the line of source that it stands in, where the file has it."""
    g = corpus(spark, sf_dir)
    return packages.analyse(g, samples.config(spark), source_lines(main_sources(spark, sf_dir)))


# how a function is reached ---------------------------------------------------------------------


@rule("SELECT v, func, statement FROM parent")
def rule_parent_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.parent_functions(corpus(spark, sf_dir))


@rule("SELECT DISTINCT a.v, a.s AS fn, CASE WHEN n.line IS NULL THEN NULL ELSE 'main.js' END AS fname FROM ast a JOIN n ON n.v = a.v AND n.id = a.d AND n.type IN ('FunctionExpression', 'ArrowFunctionExpression') WHERE a.r = 'init'")
def rule_function_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.function_files(corpus(spark, sf_dir))


@rule("SELECT * FROM tops")
def rule_top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(protocol.top_level(corpus(spark, sf_dir)))


@rule("SELECT DISTINCT * FROM b0")
def rule_export_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(protocol.exported_directly(corpus(spark, sf_dir)))


def _branch(branch: Callable[[PropertyGraph, DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = corpus(spark, sf_dir)
        found = protocol.properties(g)
        return _paths(branch(g, found, protocol.origins(g, found)))

    return run


for _i, (_name, _f) in enumerate((("exports", protocol.exported_by_exports), ("module", protocol.exported_by_module), ("module_property", protocol.exported_by_module_property), ("prototype", protocol.exported_by_prototype), ("this", protocol.exported_by_this)), 1):
    _run = _branch(_f)
    _run.__name__ = f"rule_export_by_{_name}"
    rule(f"SELECT * FROM m{_i}")(_run)


@rule("SELECT * FROM types")
def rule_exported_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first way of export that fits each function."""
    return _paths(protocol.exported_types(corpus(spark, sf_dir)))


@rule("SELECT v, fn, source_fn, step FROM rets")
def rule_returners(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protocol.returners(corpus(spark, sf_dir))
    return found.select("package_id", "fn", "source_fn", path_text(F.array("step")).alias("step"))


@rule("SELECT v, fn, caller FROM calls")
def rule_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.callers(corpus(spark, sf_dir))


@rule(
    """SELECT DISTINCT q.v, q.fn, p.func AS caller, CASE WHEN x.type = 'NewExpression' THEN 'promise' WHEN y.type = 'MemberExpression' THEN 'then' ELSE 'callback' END AS kind FROM passed q JOIN parent p USING (v, statement) JOIN ast a ON a.v = q.v AND a.s = q.statement AND a.r = 'init' JOIN n x ON x.v = q.v AND x.id = a.d JOIN ast b ON b.v = q.v AND b.s = x.id JOIN n y ON y.v = q.v AND y.id = b.d
WHERE (x.type = 'NewExpression' AND b.r = 'callee' AND y.type = 'Identifier' AND y.name = 'Promise') OR (x.type = 'CallExpression' AND b.r = 'callee' AND y.type = 'MemberExpression' AND EXISTS (SELECT 1 FROM ast c JOIN n z ON z.v = c.v AND z.id = c.d WHERE c.v = q.v AND c.s = y.id AND c.r = 'property' AND z.name = 'then'))
  OR (x.type = 'CallExpression' AND b.r = 'arg' AND y.type = 'Identifier' AND y.name = (SELECT n.name FROM n WHERE n.v = q.v AND n.id = q.fn))"""
)
def rule_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.callbacks(corpus(spark, sf_dir))


def _targets(graph: PropertyGraph) -> DataFrame:
    """Functions with a sink."""
    sinks = graph.e("SINK").select("package_id", F.col("src").alias("statement"))
    return protocol.parent_functions(graph).join(sinks, ["package_id", "statement"], "left_semi").select("package_id", F.col("func").alias("target")).distinct()


@rule(
    """SELECT v, target, path, CASE WHEN n_steps = 1 THEN CASE f WHEN 'Call' THEN 'VFunExported' WHEN 'Method' THEN 'VFunPropOfExportedObj' WHEN 'New' THEN 'VNewCall' WHEN 'TopLevel' THEN 'VTopLevel' END WHEN f = 'New' THEN 'VNewCall' WHEN f IN ('Call', 'Method') THEN 'VFunRetByExport' ELSE 'unknown' END AS type,
CASE f WHEN 'Call' THEN 'module.exports' WHEN 'Method' THEN 'module.exports.' || split_part(path, ':', 2) WHEN 'TopLevel' THEN split_part(path, ':', 3) WHEN 'New' THEN 'new module.exports' END AS source FROM (SELECT *, split_part(path, ':', 1) AS f, len(string_split(path, '>'))::INTEGER AS n_steps FROM way)"""
)
def rule_call_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls that lead from outside to each function with a sink, their class and how they begin."""
    g = corpus(spark, sf_dir)
    found = protocol.summaries(protocol.call_paths(g, _targets(g)))
    return found.select("package_id", "target", path_text(F.col("path")).alias("path"), "type", "source")


# parameters ----------------------------------------------------------------------------------

_TREE = """roots AS (SELECT f.v, f.id AS fn, split_part(split_part(o.name, '.', 2), '-', 1) AS param, o.id AS node FROM fn f JOIN ref ON ref.v = f.v AND ref.s = f.id AND ref.r = 'param' AND ref.this IS NOT TRUE JOIN obj o ON o.v = f.v AND o.id = ref.d),
seeds AS (SELECT * FROM roots UNION SELECT roots.v, fn, param, dep.d FROM roots JOIN dep ON dep.v = roots.v AND dep.s = roots.node JOIN logic ON logic.v = dep.v AND logic.choice = dep.d),
w AS (SELECT v, fn, param, node, '' AS prefix, false AS fixed FROM seeds UNION SELECT w.v, fn, param, x.d, CASE WHEN x.r = 'SO' AND NOT fixed THEN prefix || '/' || x.name ELSE prefix END, fixed OR x.r = 'DEP' FROM w JOIN pdg x ON x.v = w.v AND x.s = w.node AND x.r IS DISTINCT FROM 'ARG'),
tree AS (SELECT DISTINCT v, fn, param, prefix, node FROM w)"""


def _trees(graph: PropertyGraph) -> DataFrame:
    return param_types.parameter_trees(graph, start(graph, "fn", flow.FUNCTION))


def _prefix(c: str = "prefix") -> Column:
    return F.concat(F.when(F.size(c) > 0, F.lit("/")).otherwise(F.lit("")), F.array_join(c, "/")).alias("prefix")


@rule(f"WITH RECURSIVE {_TREE} SELECT v, fn, param, prefix, node FROM tree")
def rule_parameter_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(corpus(spark, sf_dir)).select("package_id", "fn", "param", _prefix(), F.explode("ids").alias("node"))


_NAMES = """names AS (SELECT DISTINCT v, fn, param, prefix, CASE WHEN prefix = '' THEN param ELSE string_split(prefix, '/')[-1] END AS name, true AS first FROM tree UNION SELECT t.v, t.fn, t.param, t.prefix, f.name, false FROM tree t JOIN ref ON ref.v = t.v AND ref.d = t.node JOIN fn f ON f.v = t.v AND f.id = ref.s)"""


@rule(f"WITH RECURSIVE {_TREE}, {_NAMES} SELECT v, fn, param, prefix, name, first FROM names")
def rule_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus(spark, sf_dir)
    return param_types.names_of(g, _trees(g)).select("package_id", "fn", "param", _prefix(), "name", "first").distinct()


_USES = f"""sig(fn, pos, type) AS (VALUES {", ".join(f"('{f}', {i}, '{t}')" for f, ts, _ in samples.SIGNATURES for i, t in enumerate(ts, 1))}), proto(of, method) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in samples.PROTOTYPES)}),
pa AS (SELECT i.v, i.name, a.r AS role, a.ai, p.id, p.type AS kind, p.sub FROM n i JOIN ast a ON a.v = i.v AND a.d = i.id JOIN n p ON p.v = i.v AND p.id = a.s WHERE i.type = 'Identifier'),
ch AS (SELECT a.v, a.s AS id, a.r AS role, c.id AS child, c.type, c.name, c.sub, c.raw FROM ast a JOIN n c ON c.v = a.v AND c.id = a.d),
mth AS (SELECT pa.v, pa.name, proto.of FROM pa JOIN ast u ON u.v = pa.v AND u.d = pa.id JOIN n c ON c.v = pa.v AND c.id = u.s AND c.type = 'CallExpression' JOIN ch m ON m.v = pa.v AND m.id = pa.id AND m.role = 'property' AND m.type = 'Identifier' JOIN proto ON proto.method = m.name WHERE pa.kind = 'MemberExpression' AND pa.role = 'object'),
uses AS (SELECT pa.v, pa.name, false AS first_only, lower(o.name) AS type FROM pa JOIN ch m ON m.v = pa.v AND m.id = pa.id AND m.type = 'MemberExpression' JOIN ch o ON o.v = pa.v AND o.id = m.child AND o.role = 'object' AND o.type = 'Identifier' AND o.name IN ('Array', 'Number', 'Object') WHERE pa.kind = 'CallExpression' AND pa.role = 'arg'
UNION SELECT pa.v, pa.name, false, sig.type FROM pa JOIN ch m ON m.v = pa.v AND m.id = pa.id AND m.type = 'Identifier' JOIN sig ON sig.fn = m.name AND sig.pos = pa.ai WHERE pa.kind = 'CallExpression' AND pa.role = 'arg'
UNION SELECT pa.v, pa.name, false, replace(l.raw, '''', '') FROM pa JOIN ast u ON u.v = pa.v AND u.d = pa.id JOIN fn f ON f.v = pa.v AND f.id = u.s JOIN pa q ON q.v = pa.v AND q.name = f.name AND q.kind = 'BinaryExpression' AND q.sub IN ('==', '===') AND q.role = 'left' JOIN ch l ON l.v = pa.v AND l.id = q.id AND l.role = 'right' AND l.type = 'Literal' WHERE pa.kind = 'UnaryExpression' AND pa.sub = 'typeof'
UNION SELECT v, name, true, 'function' FROM pa WHERE kind = 'CallExpression' AND role = 'callee'
UNION SELECT v, name, false, 'array' FROM mth WHERE of = 'array' UNION SELECT v, name, true, 'string' FROM mth WHERE of = 'string'
UNION SELECT v, name, false, 'array' FROM pa WHERE kind = 'ForOfStatement' AND role = 'right'
UNION SELECT pa.v, pa.name, false, CASE WHEN l.sub = 'number' THEN 'number' WHEN l.sub = 'boolean' THEN 'bool' ELSE 'string' END FROM pa JOIN ch l ON l.v = pa.v AND l.id = pa.id AND l.type = 'Literal' WHERE pa.kind = 'BinaryExpression' AND (l.sub = 'number' OR (l.sub = 'boolean' AND pa.sub IN ('==', '===')) OR (l.sub = 'string' AND pa.sub IN ('+', '==')))
UNION SELECT v, name, false, 'number' FROM pa WHERE kind = 'BinaryExpression' AND sub IN ('*', '-', '/', '**', '%', '>', '<', '>=', '<=')
UNION SELECT v, name, true, 'string' FROM pa WHERE kind = 'TemplateLiteral'
UNION SELECT pa.v, pa.name, false, 'string' FROM pa JOIN ch c ON c.v = pa.v AND c.id = pa.id AND c.role = 'callee' WHERE pa.kind IN ('CallExpression', 'NewExpression') AND pa.role = 'arg' AND pa.ai = 1 AND c.type = 'Identifier' AND c.name IN (SELECT sink FROM sinks)
UNION SELECT pa.v, pa.name, false, 'string' FROM pa JOIN ch c ON c.v = pa.v AND c.id = pa.id AND c.role = 'callee' AND c.type = 'MemberExpression' JOIN ch q ON q.v = pa.v AND q.id = c.child AND q.role = 'property' AND q.type = 'Identifier' AND q.name IN (SELECT sink FROM sinks) WHERE pa.kind = 'CallExpression' AND pa.role = 'arg' AND pa.ai = 1
UNION SELECT v, name, false, 'string' FROM pa WHERE kind = 'MemberExpression' AND sub = 'computed' AND role = 'property')"""


def _uses(graph: PropertyGraph, config: dict[str, DataFrame]) -> DataFrame:
    return param_types.uses(graph, config["sinks"], config["signatures"], config["prototypes"])


@rule(f"WITH {_USES} SELECT * FROM uses")
def rule_type_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each use of a name says about its type."""
    return _uses(corpus(spark, sf_dir), samples.config(spark))


_INFERRED = """keys AS (SELECT DISTINCT v, fn, param, prefix FROM tree), said AS (SELECT k.v, k.fn, k.param, k.prefix, u.type, u.first_only FROM names k JOIN uses u ON u.v = k.v AND u.name = k.name WHERE k.first OR NOT u.first_only),
inferred AS (SELECT k.v, k.fn, k.param, k.prefix, CASE WHEN bool_or(s.type = 'function' AND s.first_only) THEN 'function' WHEN count(s.type) = 0 THEN 'any' ELSE string_agg(DISTINCT s.type, ',' ORDER BY s.type) END AS types FROM keys k LEFT JOIN said s USING (v, fn, param, prefix) GROUP BY 1, 2, 3, 4)"""


def _inferred(graph: PropertyGraph, config: dict[str, DataFrame]) -> DataFrame:
    return param_types.inferred(graph, _trees(graph), config["sinks"], config["signatures"], config["prototypes"])


@rule(f"WITH RECURSIVE {_TREE}, {_NAMES}, {_USES}, {_INFERRED} SELECT * FROM inferred")
def rule_inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of parameters and of their properties: none: any; called: function."""
    return _inferred(corpus(spark, sf_dir), samples.config(spark)).select("package_id", "fn", "param", _prefix(), F.array_join("types", ",").alias("types"))


_PARAMETER_JSON = (
    f"""WITH RECURSIVE {_TREE}, {_NAMES}, {_USES}, {_INFERRED}, leaf AS (SELECT v, fn, param, prefix, CASE WHEN contains(types, ',') THEN '{{"_union":["' || replace(types, ',', '","') || '"]}}' ELSE '"' || types || '"' END AS json FROM inferred),
deep AS (SELECT v, fn, param, prefix[2:] AS key, json FROM leaf WHERE len(string_split(prefix, '/')) = 2),
deep2 AS (SELECT v, fn, param, split_part(prefix, '/', 2) AS key, '{{' || string_agg('"' || split_part(prefix, '/', 3) || '":' || json, ',' ORDER BY split_part(prefix, '/', 3)) || '}}' AS whole, bool_or(split_part(prefix, '/', 3) = 'length') AS long FROM leaf WHERE len(string_split(prefix, '/')) = 3 GROUP BY 1, 2, 3, 4),
inner_ AS (SELECT l.v, l.fn, l.param, d.key, CASE WHEN e2.long THEN '{{"_union":[' || e2.whole || ',"string","array"]}}' ELSE coalesce(e2.whole, d.json) END AS json FROM leaf l LEFT JOIN deep d ON d.v = l.v AND d.fn = l.fn AND d.param = l.param LEFT JOIN deep2 e2 ON e2.v = l.v AND e2.fn = l.fn AND e2.param = l.param AND e2.key = d.key WHERE l.prefix = '')
SELECT i.v, i.fn, i.param, CASE WHEN count(key) = 0 THEN any_value(l.json) ELSE '{{' || string_agg('"' || key || '":' || i.json, ',' ORDER BY key) || '}}' END AS json FROM inner_ i JOIN leaf l ON l.v = i.v AND l.fn = i.fn AND l.param = i.param AND l.prefix = '' GROUP BY 1, 2, 3"""
)


@rule(_PARAMETER_JSON)
def rule_parameter_types_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parameter's type as JSON, folded from its properties."""
    return packages.folded_parameters(_inferred(corpus(spark, sf_dir), samples.config(spark))).select("package_id", "fn", "param", "json")


#: Which parameters of a function the pollution of a package goes through, by name.
ROLES = [("o", "object"), ("z", "value"), ("a", "value")]
_LEAF = """leaf AS (SELECT v, fn, param, prefix, string_split(prefix, '/')[2:] AS way, CASE WHEN contains(types, ',') THEN '{"_union":["' || replace(types, ',', '","') || '"]}' ELSE '"' || types || '"' END AS json FROM inferred)"""


def _fold_sql(below: str, level: int) -> str:
    """The nodes of a level from those below it: each by the rules for its properties."""
    kids = f"kids{level} AS (SELECT v, fn, param, way[:{level}] AS way, list(struct_pack(name := way[{level + 1}], json := json) ORDER BY way[{level + 1}]) AS c FROM {below} WHERE len(way) = {level + 1} GROUP BY 1, 2, 3, 4)"
    names = "list_transform(k.c, lambda x: x.name)"
    digits = f"list_filter({names}, lambda x: regexp_full_match(x, '[0-9]+'))"
    rest = f"list_filter({names}, lambda x: NOT regexp_full_match(x, '[0-9]+|[*]|length'))"
    gap = f"""CASE WHEN gap > {packages.GAP} THEN '{{"_any":' || gap || '}},' ELSE repeat('"any",', gap::BIGINT) END"""
    item = f"""(SELECT string_agg({gap} || json, ',' ORDER BY nth) FROM (SELECT nth, json, nth - coalesce(lag(nth) OVER (ORDER BY nth), -1) - 1 AS gap FROM (SELECT try_cast(x.name AS HUGEINT) AS nth, x.json AS json FROM (SELECT unnest(k.c) AS x) WHERE regexp_full_match(x.name, '[0-9]+'))))"""
    array = f"""CASE WHEN '[' || {item} || ']' = '["any"]' THEN '"array"' ELSE '[' || {item} || ']' END"""
    whole = """'{' || array_to_string(list_transform(k.c, lambda x: '"' || x.name || '":' || x.json), ',') || '}'"""
    loose = f"(list_contains({names}, '*') OR list_contains({names}, 'length'))"
    json = f"""CASE WHEN k.c IS NULL THEN l.json WHEN {loose} AND {level} = 0 AND r.role = 'object' THEN '"object"' WHEN {loose} AND {level} = 0 AND r.role = 'value' THEN '{packages.POLLUTING}'
  WHEN len({digits}) > 0 AND len({rest}) > 0 THEN '{{"_union":[' || {whole} || ',' || {array} || ']}}' WHEN len({digits}) > 0 THEN {array} WHEN list_contains({names}, 'length') AND len(list_filter({rest}, lambda x: x <> 'charAt')) = 0 THEN '{packages.TEXT}'
  WHEN {loose} THEN '{{"_union":["object","array"]}}' ELSE {whole} END"""
    return f"{kids}, fold{level} AS (SELECT l.v, l.fn, l.param, l.way, {json} AS json FROM leaf l LEFT JOIN kids{level} k ON k.v = l.v AND k.fn = l.fn AND k.param = l.param AND k.way = l.way LEFT JOIN roles r ON r.param = l.param WHERE len(l.way) = {level})"


@rule(
    f"""WITH RECURSIVE {_TREE}, {_NAMES}, {_USES}, {_INFERRED}, {_LEAF}, roles(param, role) AS (VALUES {", ".join(f"('{p}', '{r}')" for p, r in ROLES)}),
{_fold_sql("leaf", 1)}, both_ AS (SELECT v, fn, param, way, json FROM fold1 UNION ALL SELECT v, fn, param, way, json FROM leaf WHERE len(way) = 0), {_fold_sql("both_", 0)}
SELECT f.v, f.fn, f.param, CASE WHEN f.json = '"any"' AND r.role = 'object' THEN '"object"' ELSE f.json END AS json FROM fold0 f LEFT JOIN roles r ON r.param = f.param"""
)
def rule_simplified_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As JSON for prototype pollution: numeric keys are an array, gaps filled or counted; length alone may be an object, strings or a string; polluted objects and values."""
    g = corpus(spark, sf_dir)
    found = _inferred(g, samples.config(spark))
    roles = spark.createDataFrame(ROLES, "param string, role string")
    polluted = found.select("package_id", "fn", "param").distinct().join(F.broadcast(roles), "param")
    return packages.folded_parameters(found, ("charAt",), polluted).select("package_id", "fn", "param", "json")


@rule("SELECT DISTINCT a.v, val.id AS value, p.name AS param_name FROM obj h JOIN pdg s0 ON s0.v = h.v AND s0.s = h.id AND s0.name = '*' JOIN obj sl ON sl.v = h.v AND sl.id = s0.d JOIN pdg_r w ON w.v = h.v AND w.a = sl.id JOIN obj ao ON ao.v = h.v AND ao.id = w.b JOIN pdg a ON a.v = h.v AND a.s = ao.id AND a.r = 'ARG' JOIN cal c ON c.v = h.v AND c.id = a.d JOIN cgr g ON g.v = h.v AND g.s = c.id JOIN ref ON ref.v = h.v AND ref.s = g.d AND ref.r = 'param' JOIN obj p ON p.v = h.v AND p.id = ref.d JOIN pdg_r u ON u.v = h.v AND u.a = p.id JOIN obj val ON val.v = h.v AND val.id = u.b WHERE contains(h.name, 'arguments-')")
def rule_arguments_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus(spark, sf_dir)
    return param_types.arguments_dependency(g, start(g, "value", flow.OBJECT))


@rule("SELECT r0.v, r0.d AS value, string_agg(DISTINCT a.s::VARCHAR, ',' ORDER BY a.s::VARCHAR) AS args FROM pdg r0 JOIN obj o ON o.v = r0.v AND o.id = r0.d JOIN cal c ON c.v = r0.v AND c.id = r0.s JOIN pdg a ON a.v = r0.v AND a.d = c.id AND a.r = 'ARG' JOIN obj ao ON ao.v = r0.v AND ao.id = a.s WHERE r0.r = 'RET' GROUP BY 1, 2")
def rule_value_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus(spark, sf_dir)
    found = param_types.value_dependencies(g, start(g, "value", flow.OBJECT))
    return found.select("package_id", "value", F.array_join(F.array_sort(F.transform("args", lambda x: x.cast("string"))), ",").alias("args"))


@rule(
    f"""WITH RECURSIVE inj AS ({_INJECTION}), pol AS ({_POLLUTION}), pj AS ({_PARAMETER_JSON}), found AS (SELECT v, vuln_type, sink_lineno, sink_function FROM inj UNION SELECT v, vuln_type, sink_lineno, sink_function FROM pol),
walk2 AS (SELECT DISTINCT d.v, p.func AS target, p.func AS fn, '' AS suffix, [p.func] AS seen FROM found d JOIN parent p ON p.v = d.v AND p.statement = d.sink_function UNION ALL SELECT w.v, w.target, u.nxt, u.step || w.suffix, list_append(w.seen, u.nxt) FROM walk2 w JOIN ups u ON u.v = w.v AND u.fn = w.fn WHERE NOT list_contains(w.seen, u.nxt) AND NOT EXISTS (SELECT 1 FROM begins b WHERE b.v = w.v AND b.fn = w.fn)),
way2 AS (SELECT DISTINCT f.v, f.target, b.path || f.suffix AS path FROM (SELECT v, target, fn, arg_min(suffix, (len(seen), suffix)) AS suffix FROM walk2 GROUP BY 1, 2, 3) f JOIN begins b ON b.v = f.v AND b.fn = f.fn),
pos AS (SELECT f.v, f.id AS fn, split_part(split_part(o.name, '.', 2), '-', 1) AS param, min(ref.pi) AS pi FROM fn f JOIN ref ON ref.v = f.v AND ref.s = f.id AND ref.r = 'param' JOIN obj o ON o.v = f.v AND o.id = ref.d GROUP BY 1, 2, 3),
args AS (SELECT v, fn, '[' || string_agg('"' || param || '"', ',' ORDER BY pi) || ']' AS params, '{{' || string_agg('"' || param || '":' || json, ',' ORDER BY pi) || '}}' AS types FROM pj JOIN pos USING (v, fn, param) GROUP BY 1, 2),
kept AS (SELECT DISTINCT v, target, CASE WHEN len(s) = 2 AND s[1] LIKE 'TopLevel:%' THEN s[2:] ELSE s END AS s FROM (SELECT v, target, string_split(path, '>') AS s FROM way2)),
step AS (SELECT v, target, s, i, split_part(s[i], ':', 1) AS f, nullif(split_part(s[i], ':', 2), '') AS prop, split_part(s[i], ':', 3) AS name, split_part(s[i], ':', 4)::BIGINT AS fn FROM (SELECT *, unnest(generate_series(1, len(s))) AS i FROM kept)),
said AS (SELECT *, CASE WHEN i = 1 THEN CASE f WHEN 'Call' THEN 'module.exports' WHEN 'Method' THEN 'module.exports.' || prop WHEN 'New' THEN 'new module.exports' || coalesce('.' || prop, '') WHEN 'TopLevel' THEN name END ELSE CASE f WHEN 'Call' THEN '' WHEN 'Method' THEN '.' || prop WHEN 'New' THEN 'new' ELSE 'unknown' END END AS source FROM step),
one AS (SELECT said.*, '"source":"' || source || '","tainted_params":' || coalesce(params, '[]') || ',"params_types":' || coalesce(types, '{{}}') AS text FROM said LEFT JOIN args USING (v, fn)),
whole AS (SELECT v, target, s, max(CASE WHEN i = 1 THEN f END) AS f, max(CASE WHEN i = 1 THEN source END) AS source, string_agg(text, ',"returns":{{' ORDER BY i) || repeat('}}', count(*) - 1) AS text, count(*) AS n FROM one GROUP BY 1, 2, 3),
kinds AS (SELECT *, CASE WHEN n = 1 THEN CASE f WHEN 'Call' THEN 'VFunExported' WHEN 'Method' THEN 'VFunPropOfExportedObj' WHEN 'New' THEN 'VNewCall' WHEN 'TopLevel' THEN 'VTopLevel' END WHEN f = 'New' THEN 'VNewCall' WHEN f IN ('Call', 'Method') THEN 'VFunRetByExport' ELSE 'unknown' END AS type FROM whole)
SELECT DISTINCT k.v, d.sink_function, k.type, k.source, '{{"type":"' || k.type || '","filename":' || CASE WHEN d.sink_lineno IS NULL THEN 'null' ELSE '"main.js"' END || ',"vuln_type":' || coalesce('"' || d.vuln_type || '"', 'null') || ',"sink":"' || CASE WHEN d.sink_lineno <= 6 THEN 'statement ' || d.sink_lineno ELSE '' END || '","sink_lineno":' || coalesce(d.sink_lineno::VARCHAR, 'null') || ',' || k.text || '}}' AS summary
FROM found d JOIN parent p ON p.v = d.v AND p.statement = d.sink_function JOIN kinds k ON k.v = d.v AND k.target = p.func"""
)
def rule_taint_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection with the way to reach it: the calls from outside, one within the other, their parameters and the types of these."""
    g = corpus(spark, sf_dir)
    found = packages.analyse(g, samples.config(spark), source_lines(main_sources(spark, sf_dir)), with_types=True)
    return found.select("package_id", "sink_function", "type", "source", "summary")


# the corpus as a whole ---------------------------------------------------------------------------


@rule("SELECT v, count(*) AS n_nodes, (SELECT count(*) FROM e WHERE e.v = n.v) AS n_edges FROM n GROUP BY 1")
def rule_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).counts()


@rule("SELECT v, 0 AS part, 'digraph {' AS line FROM n GROUP BY 1 UNION ALL SELECT v, 3, '}' FROM n GROUP BY 1 UNION ALL SELECT v, 1, '  ' || id || ' [label=\"' || concat_ws(' ', id::VARCHAR, type, name) || '\"];' FROM n UNION ALL SELECT v, 2, '  ' || s || ' -> ' || d || ' [label=\"' || concat_ws(':', rel, r, name) || '\"];' FROM e WHERE rel <> 'AST'")
def rule_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.drawing(corpus(spark, sf_dir), ("AST",))


# files -----------------------------------------------------------------------------------------

_FILES = """files AS (SELECT page_id::VARCHAR AS package_id, page_id, unnest(CASE page_id % 3 WHEN 0 THEN ['package.json', 'lib/main.js', 'lib/a/index.js', 'b.js'] WHEN 1 THEN ['src/index.js', 'dist/index.js', 'src/b.js'] ELSE ['index.js', 'b.js', 'readme.md'] END) AS path FROM pages WHERE page_id IS NOT NULL)"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """package_id, path, content: a small package for each page, of one of three shapes, that serves the page's number as a port."""
    shapes = [
        [("package.json", '{"main": "./lib/main"}'), ("lib/main.js", "const a = require('./a'), b = require(\"../b\");"), ("lib/a/index.js", "import b from '../../b.js'"), ("b.js", "require('./none'); require('http').createServer(f).listen(PORT)")],
        [("src/index.js", "require('./b')"), ("dist/index.js", ""), ("src/b.js", "export * from './index'")],
        [("index.js", "require('fs').readFile(x)"), ("b.js", "s = createServer(f);\ns.listen(\"PORT\")"), ("readme.md", "require('./index')")],
    ]
    rows = spark.createDataFrame([(i, p, c) for i, fs in enumerate(shapes) for p, c in fs], "shape int, path string, content string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id is not null").select(F.col("page_id").cast("string").alias("package_id"), (F.col("page_id") % len(shapes)).cast("int").alias("shape"))
    return pages.join(F.broadcast(rows), "shape").select("package_id", "path", F.replace("content", F.lit("PORT"), F.col("package_id")).alias("content"))


def _file_query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, f"WITH {_FILES} {sql}"
        return f

    return add


@_file_query("SELECT package_id, CASE page_id % 3 WHEN 0 THEN 'lib/main.js' WHEN 1 THEN 'src/index.js' ELSE 'index.js' END AS path FROM files GROUP BY 1, 2, page_id")
def entry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By package.json, else by the usual places."""
    return packages.entry_files(page_files(spark, sf_dir))


_NEEDS = "(VALUES (0, 'lib/main.js', 'lib/a/index.js'), (0, 'lib/main.js', 'b.js'), (0, 'lib/a/index.js', 'b.js'), (1, 'src/index.js', 'src/b.js'), (1, 'src/b.js', 'src/index.js')) t(shape, path, dependency)"


@_file_query(f"SELECT package_id, path, dependency FROM (SELECT DISTINCT package_id, page_id FROM files) JOIN {_NEEDS} ON shape = page_id % 3")
def file_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of a package require or import."""
    return packages.file_dependencies(page_files(spark, sf_dir))


@_file_query(f"SELECT package_id, path || ': ' || string_agg(dependency, ', ' ORDER BY dependency) AS line FROM (SELECT DISTINCT package_id, page_id FROM files) JOIN {_NEEDS} ON shape = page_id % 3 GROUP BY package_id, path")
def dependency_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.dependency_text(page_files(spark, sf_dir))


@_file_query("SELECT package_id, path FROM files WHERE path IN ('lib/main.js', 'lib/a/index.js') OR (path = 'b.js' AND page_id % 3 = 0) OR path IN ('src/index.js', 'src/b.js') OR path = 'index.js'")
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry files and all that they need."""
    files = page_files(spark, sf_dir)
    return packages.dependency_closure(files, packages.entry_files(files))


@_file_query("SELECT package_id, path, package_id::INTEGER AS port FROM files WHERE path = 'b.js'")
def server_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that create a server, and the port on which they listen."""
    return protocol.server_ports(page_files(spark, sf_dir))


@_file_query("SELECT package_id, (row_number() OVER (PARTITION BY package_id ORDER BY path))::INTEGER AS nth, path FROM files WHERE path LIKE '%.js'")
def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts of each package in the order of their paths."""
    return packages.script_files(page_files(spark, sf_dir))
