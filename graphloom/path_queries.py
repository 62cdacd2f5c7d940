"""Queries of witness paths, components, regular paths, dataflow and dominators, over the tables and the corpus of programs, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .model import PropertyGraph
from .operators.closure import shared_folder, written
from .operators.dataflow import reaching_definitions
from .operators.dominators import dominators, versions
from .operators.match import ends, label
from .operators.regular import many, matches, maybe, seq, step
from .plans import aliases, dataflow, detect, packages
from .plans.flow import call_graph
from .queries import key_of, table
from .rule_queries import _NEEDS, page_files, rule_sql
from .sources import samples
from .sources.samples import corpus
from .sources.table_graph import TURNS, TYPES, UNIT, table_graph
from .streaming.stored import EDGES, change_closure, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str, over_programs: bool = False):
    """Registers a query with its SQL; over_programs: as for the rules, a statement over their tables that gives v."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = rule_sql(sql) if over_programs else sql
        return f

    return add


# files of packages --------------------------------------------------------------------------------

_FILES = f"""shapes AS (SELECT DISTINCT page_id::VARCHAR AS package_id, page_id % 3 AS shape FROM pages WHERE page_id IS NOT NULL), needs AS (SELECT * FROM {_NEEDS}),
scripts(shape, path) AS (VALUES (0, 'lib/main.js'), (0, 'lib/a/index.js'), (0, 'b.js'), (1, 'src/index.js'), (1, 'dist/index.js'), (1, 'src/b.js'), (2, 'index.js'), (2, 'b.js'))"""


@query(
    f"""WITH RECURSIVE {_FILES}, r AS (SELECT shape, path AS a, path AS b FROM scripts UNION SELECT r.shape, r.a, n.dependency FROM r JOIN needs n ON n.shape = r.shape AND n.path = r.b),
c AS (SELECT x.shape, x.a AS path, min(x.b) AS component FROM r x JOIN r y ON y.shape = x.shape AND y.a = x.b AND y.b = x.a GROUP BY 1, 2),
l AS (SELECT shape, component, 0 AS level FROM c UNION SELECT l.shape, a.component, l.level + 1 FROM l JOIN c b ON b.shape = l.shape AND b.component = l.component JOIN needs n ON n.shape = l.shape AND n.dependency = b.path JOIN c a ON a.shape = l.shape AND a.path = n.path WHERE a.component <> l.component),
m AS (SELECT shape, component, max(level) AS level FROM l GROUP BY 1, 2) SELECT package_id, path, component, level FROM c JOIN m USING (shape, component) JOIN shapes USING (shape)"""
)
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles of files that need each other, and the order in which files can be read."""
    return packages.dependency_levels(page_files(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_FILES}, roots(shape, path) AS (VALUES (0, 'lib/main.js'), (1, 'src/index.js'), (2, 'index.js')),
w AS (SELECT shape, path, []::VARCHAR[] AS way FROM roots UNION ALL SELECT w.shape, n.dependency, list_append(w.way, n.dependency) FROM w JOIN needs n ON n.shape = w.shape AND n.path = w.path WHERE NOT list_contains(w.way, n.dependency)),
f AS (SELECT shape, path, arg_min(way, (len(way), way)) AS way FROM w GROUP BY 1, 2) SELECT package_id, path, array_to_string(way, ' > ') AS way FROM f JOIN shapes USING (shape)"""
)
def dependency_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a package needs each of its files: a shortest way from its entry file."""
    files = page_files(spark, sf_dir)
    found = packages.dependency_paths(files, packages.entry_files(files))
    return found.select("package_id", "path", F.array_join("way", " > ").alias("way"))


# turns of conversations -----------------------------------------------------------------------------


def _turns(spark: SparkSession, sf_dir: str) -> tuple[PropertyGraph, DataFrame]:
    graph = table_graph(spark, sf_dir)
    return graph, ends(graph, graph.e("CFG"), ["Turn"], ["Turn"]).select("package_id", "src", "dst")


def _place(column: str, key: str) -> list[Column]:
    """conv_id and turn (as key) of a node."""
    return [F.expr(f"({column} - {TYPES['Turn'] * UNIT}) div {TURNS}").alias("conv_id"), _turn(column).alias(key)]


def _turn(column: str) -> Column:
    return F.pmod(key_of(column, "Turn"), F.lit(TURNS)).cast("long")


_CHAIN = """t AS (SELECT DISTINCT conv_id, turn, role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL), g AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM t)"""


@query(
    f"""WITH {_CHAIN}, roles AS (SELECT DISTINCT role AS variable FROM t WHERE role IS NOT NULL), x AS (SELECT conv_id, turn, variable, last_value(CASE WHEN role = variable THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id, part, variable ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS definition FROM g, roles)
SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, variable, definition::BIGINT AS definition FROM x WHERE definition IS NOT NULL"""
)
def turn_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn says something anew for its role: what of each role is said last before a turn."""
    graph, edges = _turns(spark, sf_dir)
    said = graph.n("Turn").select("package_id", F.col("node_id").alias("node"), F.col("identifier_name").alias("variable"))
    found = reaching_definitions(edges, said)
    return found.select(*_place("node", "turn"), "variable", _turn("definition").alias("definition"))


@query(
    f"""WITH RECURSIVE {_CHAIN}, w AS (SELECT conv_id, turn, 0 AS s FROM t WHERE turn = 0 UNION SELECT w.conv_id, t.turn, CASE WHEN t.role = 'assistant' THEN 2 WHEN s = 2 THEN 3 ELSE 1 END FROM w JOIN t ON t.conv_id = w.conv_id AND t.turn = w.turn + 1
  WHERE (s = 0 AND t.role = 'user') OR (s IN (0, 1, 3) AND t.role = 'assistant') OR (s = 2 AND t.role = 'user')) SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn FROM w WHERE s = 3 GROUP BY ALL"""
)
def turn_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns up to which a conversation, after its first turn, is a question perhaps and then answers and questions by turns."""
    graph, edges = _turns(spark, sf_dir)
    edges = label(graph, edges, "dst", "Turn", keep={"role": "identifier_name"})
    by = lambda role: step(F.coalesce(F.col("role") == role, F.lit(False)))
    pattern = seq(maybe(by("user")), many(seq(by("assistant"), by("user")), 1))
    first = graph.n("Turn").where(_turn("node_id") == 0)
    found = matches(edges, first.select("package_id", F.col("node_id").alias("origin"), F.col("node_id").alias("node")).distinct(), pattern)
    return found.select(*_place("node", "turn")).distinct()


# states of users ------------------------------------------------------------------------------------

_STATES = """ev AS (SELECT user_id AS u, ts, event_id, event_type, min(event_id) OVER (PARTITION BY user_id, event_type, json_extract(props, '$.k')::BIGINT // 10) AS s FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL),
nx AS (SELECT u, s, lead(s) OVER (PARTITION BY u ORDER BY ts, event_id) AS d, row_number() OVER (PARTITION BY u ORDER BY ts, event_id) AS i FROM ev), ed AS (SELECT DISTINCT u, s, d FROM nx WHERE d IS NOT NULL), node AS (SELECT DISTINCT u, s FROM nx),
r AS (SELECT a.u, n.s AS x, a.s AS v FROM nx a JOIN node n ON n.u = a.u AND n.s <> a.s WHERE a.i = 1 UNION SELECT r.u, r.x, ed.d FROM r JOIN ed ON ed.u = r.u AND ed.s = r.v WHERE ed.d <> r.x),
dom AS (SELECT a.u, a.s AS x, b.s AS v FROM node a JOIN node b ON b.u = a.u AND b.s <> a.s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.u = a.u AND r.x = a.s AND r.v = b.s)),
depth AS (SELECT n.u, n.s AS x, count(dom.x) AS n FROM node n LEFT JOIN dom ON dom.u = n.u AND dom.v = n.s GROUP BY 1, 2)"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A user's events of one type and band of k are a state, named by the first event_id. Edges from each event's state to the next one's; each user's first state; the type of each state."""
    events = table(spark, sf_dir, "events").where("user_id is not null and event_id is not null and ts is not null")
    band = F.floor(text.json_int(F.col("props"), "$.k") / 10)
    events = events.select(F.col("user_id").cast("string").alias("package_id"), "ts", "event_id", "event_type", F.to_json(F.struct("event_type", band.alias("band"))).alias("kind"), F.to_date("ts").alias("day"))
    named = written(events.groupBy("package_id", "kind").agg(F.min("event_id").alias("node"), F.first("event_type").alias("variable")))
    events = written(events.join(named.select("package_id", "kind", "node"), ["package_id", "kind"]).select("package_id", "day", "ts", "event_id", "node"))
    # the next event of a day in a window for each day, so that no user's events are all in one task; then that of the next day
    follows = events.withColumn("next", F.lead("node").over(Window.partitionBy("package_id", "day").orderBy("ts", "event_id")))
    days = events.groupBy("package_id", "day").agg(F.min_by("node", F.struct("ts", "event_id")).alias("first"))
    days = days.withColumns({"later": F.lead("first").over(Window.partitionBy("package_id").orderBy("day")), "number": F.row_number().over(Window.partitionBy("package_id").orderBy("day"))})
    over_night = follows.where("next is null").join(days, ["package_id", "day"]).select("package_id", F.col("node").alias("src"), F.col("later").alias("dst"))
    edges = follows.select("package_id", F.col("node").alias("src"), F.col("next").alias("dst")).unionByName(over_night).where("dst is not null")
    return edges.distinct(), days.where("number = 1").select("package_id", F.col("first").alias("node")), named.select("package_id", "node", "variable")


@query(f"WITH RECURSIVE {_STATES} SELECT n.u AS user_id, n.s AS state, arg_max(dom.x, depth.n) AS idom FROM node n LEFT JOIN dom ON dom.u = n.u AND dom.v = n.s LEFT JOIN depth ON depth.u = dom.u AND depth.x = dom.x GROUP BY 1, 2")
def event_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which state a user must have been in last, whatever way they came to a state."""
    edges, roots, _ = _states(spark, sf_dir)
    return dominators(edges, roots).select(F.col("package_id").cast("long").alias("user_id"), F.col("node").alias("state"), "idom")


@query(
    f"""WITH RECURSIVE {_STATES}, df AS (SELECT DISTINCT e.u, a.x, e.d AS w FROM ed e JOIN (SELECT u, x, v FROM dom UNION ALL SELECT u, s, s FROM node) a ON a.u = e.u AND a.v = e.s WHERE NOT EXISTS (SELECT 1 FROM dom y WHERE y.u = e.u AND y.x = a.x AND y.v = e.d)),
def AS (SELECT DISTINCT u, s, event_type AS variable FROM ev WHERE event_type IS NOT NULL),
phi AS (SELECT df.u, df.w AS s, variable FROM def JOIN df ON df.u = def.u AND df.x = def.s UNION SELECT df.u, df.w, variable FROM phi JOIN df ON df.u = phi.u AND df.x = phi.s),
made AS (SELECT *, false AS is_join FROM def UNION ALL SELECT *, true FROM phi),
cand AS (SELECT dom.u, dom.v, variable, made.s AS version, is_join, 2 * depth.n + (NOT is_join)::INT AS p FROM dom JOIN made ON made.u = dom.u AND made.s = dom.x JOIN depth ON depth.u = dom.u AND depth.x = dom.x UNION ALL SELECT phi.u, phi.s, variable, phi.s, true, 2 * n FROM phi JOIN depth ON depth.u = phi.u AND depth.x = phi.s)
SELECT u AS user_id, v AS state, variable, arg_max(version, p) AS version, arg_max(is_join, p) AS is_join FROM cand GROUP BY 1, 2, 3"""
)
def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each state says something anew for its type: the one version of each type that a state sees, and whether ways meet there."""
    found = versions(*_states(spark, sf_dir))
    return found.select(F.col("package_id").cast("long").alias("user_id"), F.col("node").alias("state"), "variable", "version", "is_join")


@query(
    f"""WITH RECURSIVE {_STATES.split("r AS (")[0].rstrip().rstrip(",")}, kept AS (SELECT * FROM ed WHERE (s + d) % 5 <> 0 OR (s + d) % 10 = 0), c AS (SELECT u, s, d FROM kept UNION SELECT c.u, c.s, kept.d FROM c JOIN kept ON kept.u = c.u AND kept.s = c.d)
SELECT u AS user_id, s AS state, d AS reached FROM c"""
)
def event_closure_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which states lead to which, kept up to date: two thirds of the steps arrive, then the others while a fifth is withdrawn, then half of that comes back."""
    edges = written(_states(spark, sf_dir)[0])
    folder, number = f"{shared_folder(spark)}/updates-{uuid.uuid4().hex}", F.col("src") + F.col("dst")
    change = lambda rows, withdrawn: rows.withColumn("withdrawn", F.lit(withdrawn))
    change_closure(spark, folder, 0, change(edges.where(number % 3 != 0), False))
    change_closure(spark, folder, 1, change(edges.where(number % 3 == 0), False).unionByName(change(edges.where(number % 5 == 0), True)))
    change_closure(spark, folder, 2, change(edges.where(number % 10 == 0), False))
    return stored(spark, folder, "closure", EDGES).select(F.col("package_id").cast("long").alias("user_id"), F.col("src").alias("state"), F.col("dst").alias("reached"))


# programs -------------------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE ok AS (SELECT DISTINCT v, node FROM declared JOIN confirmed USING (v, node)), fe AS (SELECT DISTINCT p.v, p.k, p.s, p.d FROM pdg p JOIN flow f ON f.v = p.v AND f.s = p.s AND f.d = p.d),
far AS (SELECT v, node, 0 AS n FROM ok UNION SELECT far.v, fe.d, n + 1 FROM far JOIN fe ON fe.v = far.v AND fe.s = far.node WHERE n < 100), near AS (SELECT v, node, min(n) AS n FROM far GROUP BY 1, 2),
way AS (SELECT v, node, []::BIGINT[] AS path FROM ok UNION ALL SELECT w.v, fe.d, list_append(w.path, fe.k) FROM way w JOIN fe ON fe.v = w.v AND fe.s = w.node JOIN near a ON a.v = w.v AND a.node = fe.d AND a.n = len(w.path) + 1)
SELECT DISTINCT p.v, p.vuln_type, p.sink_lineno, p.sink_function, array_to_string(arg_min(w.path, w.path), ',') AS path FROM place p JOIN n z ON z.v = p.v AND z.id = p.sink AND z.type = 'TAINT_SINK' JOIN way w ON w.v = p.v AND w.node = p.sink GROUP BY ALL""",
    over_programs=True,
)
def rule_witness_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injections, each with a shortest path of edges from a parameter that an attacker controls to the sink."""
    found = detect.injection_witnesses(corpus(spark, sf_dir), samples.config(spark)["sinks"])
    return found.select("package_id", "vuln_type", "sink_lineno", "sink_function", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query(
    """WITH RECURSIVE fns AS (SELECT a.v, a.s AS fn FROM ast a JOIN n ON n.v = a.v AND n.id = a.d AND n.type IN ('FunctionExpression', 'ArrowFunctionExpression') WHERE a.r = 'init' UNION SELECT v, func FROM cg UNION SELECT v, callee FROM cg),
r AS (SELECT v, fn AS a, fn AS b FROM fns UNION SELECT r.v, r.a, cg.callee FROM r JOIN cg ON cg.v = r.v AND cg.func = r.b), c AS (SELECT x.v, x.a AS fn, min(x.b) AS component FROM r x JOIN r y ON y.v = x.v AND y.a = x.b AND y.b = x.a GROUP BY 1, 2),
l AS (SELECT v, component, 0 AS level FROM c UNION SELECT l.v, a.component, l.level + 1 FROM l JOIN c b ON b.v = l.v AND b.component = l.component JOIN cg ON cg.v = l.v AND cg.callee = b.fn JOIN c a ON a.v = l.v AND a.fn = cg.func WHERE a.component <> l.component)
SELECT c.v, c.fn, c.component, max(l.level) AS level FROM c JOIN l ON l.v = c.v AND l.component = c.component GROUP BY 1, 2, 3""",
    over_programs=True,
)
def rule_function_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that call each other in a circle, and the order from callees to callers."""
    return dataflow.function_levels(corpus(spark, sf_dir))


@query(
    """WITH RECURSIVE defs AS (SELECT f.v, f.id AS node, f.name AS variable FROM fn f JOIN cfg ON cfg.v = f.v AND f.id IN (cfg.s, cfg.d) WHERE f.name IS NOT NULL UNION SELECT a.v, a.s, i.name FROM ast a JOIN n st ON st.v = a.v AND st.id = a.s AND st.type = 'ExpressionStatement' JOIN n x ON x.v = a.v AND x.id = a.d AND x.type = 'AssignmentExpression' JOIN ast b ON b.v = a.v AND b.s = a.d AND b.r = 'left' JOIN n i ON i.v = a.v AND i.id = b.d AND i.type = 'Identifier'),
rd AS (SELECT d.v, d.variable, d.node AS definition, cfg.d AS node FROM defs d JOIN cfg ON cfg.v = d.v AND cfg.s = d.node UNION SELECT rd.v, rd.variable, rd.definition, cfg.d FROM rd JOIN cfg ON cfg.v = rd.v AND cfg.s = rd.node WHERE NOT EXISTS (SELECT 1 FROM defs x WHERE x.v = rd.v AND x.node = rd.node AND x.variable = rd.variable))
SELECT v, node, variable, definition FROM rd""",
    over_programs=True,
)
def rule_reaching_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each statement may read of each variable."""
    return dataflow.reaching(corpus(spark, sf_dir))


@query(
    """WITH RECURSIVE w AS (SELECT v, s AS fn, d AS node FROM ref WHERE r = 'param' UNION SELECT w.v, w.fn, f.d FROM w JOIN free f ON f.v = w.v AND f.s = w.node)
SELECT DISTINCT w.v, w.fn, k.s AS statement FROM w JOIN e k ON k.v = w.v AND k.d = w.node AND k.rel = 'SINK' JOIN fn ON fn.v = w.v AND fn.id = w.fn""",
    over_programs=True,
)
def rule_regular_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and the sinks to which a parameter leads, by the pattern param, any dependencies but arguments, sink."""
    return dataflow.sinks_of_parameters(corpus(spark, sf_dir))


_STATEMENTS = """names AS (SELECT v, name, min(id) AS x FROM n WHERE type IN ('Identifier', 'VariableDeclarator') AND name IS NOT NULL GROUP BY 1, 2),
val AS (SELECT n.v, n.id, CASE n.type WHEN 'Identifier' THEN names.x ELSE n.id END AS x FROM n LEFT JOIN names ON names.v = n.v AND names.name = n.name WHERE n.type IN ('Identifier', 'MemberExpression', 'ObjectExpression')),
mem AS (SELECT DISTINCT m.v, m.id, val.x AS owner, CASE WHEN p.type = 'Literal' THEN regexp_replace(p.raw, '^[''"]|[''"]$', '', 'g') WHEN m.sub = 'computed' THEN '*' ELSE coalesce(p.name, '*') END AS prop FROM n m JOIN ast o ON o.v = m.v AND o.s = m.id AND o.r = 'object' JOIN val ON val.v = m.v AND val.id = o.d AND val.x IS NOT NULL LEFT JOIN ast a ON a.v = m.v AND a.s = m.id AND a.r = 'property' LEFT JOIN n p ON p.v = m.v AND p.id = a.d WHERE m.type = 'MemberExpression'),
asg AS (SELECT l.v, l.d AS lft, val.x AS src FROM n JOIN ast l ON l.v = n.v AND l.s = n.id AND l.r = 'left' JOIN ast r ON r.v = n.v AND r.s = n.id AND r.r = 'right' JOIN val ON val.v = n.v AND val.id = r.d WHERE n.type = 'AssignmentExpression' AND val.x IS NOT NULL),
cp AS (SELECT i.v, names.x AS t, val.x AS s FROM n d JOIN ast i ON i.v = d.v AND i.s = d.id AND i.r = 'init' JOIN val ON val.v = d.v AND val.id = i.d JOIN names ON names.v = d.v AND names.name = d.name WHERE d.type = 'VariableDeclarator' AND val.x IS NOT NULL
  UNION SELECT asg.v, names.x, asg.src FROM asg JOIN n l ON l.v = asg.v AND l.id = asg.lft AND l.type = 'Identifier' JOIN names ON names.v = l.v AND names.name = l.name),
wt AS (SELECT asg.v, mem.owner AS t, mem.prop, asg.src AS s FROM asg JOIN mem ON mem.v = asg.v AND mem.id = asg.lft), cell0 AS (SELECT v, id AS o, '' AS prop, id AS x FROM n WHERE false)"""


def _round(i: int) -> str:
    """What variables may be by the cells of the round before, then the cells by what variables may be."""
    return f"""pt{i} AS (SELECT v, id AS x, id AS o FROM n WHERE type = 'ObjectExpression' UNION SELECT * FROM ld{i} UNION SELECT cp.v, cp.t, w.o FROM pt{i} w JOIN cp ON cp.v = w.v AND cp.s = w.x),
cell{i} AS (SELECT DISTINCT wt.v, b.o, wt.prop, w.o AS x FROM wt JOIN pt{i} b ON b.v = wt.v AND b.x = wt.t JOIN pt{i} w ON w.v = wt.v AND w.x = wt.s),
ld{i + 1} AS (SELECT DISTINCT mem.v, mem.id AS x, c.x AS o FROM mem JOIN pt{i} b ON b.v = mem.v AND b.x = mem.owner JOIN cell{i} c ON c.v = mem.v AND c.o = b.o AND (mem.prop = c.prop OR '*' IN (mem.prop, c.prop)))"""


@query(
    f"""WITH RECURSIVE {_STATEMENTS}, ld1 AS (SELECT v, o AS x, x AS o FROM cell0), {", ".join(map(_round, range(1, 8)))}
SELECT DISTINCT p.v, names.name, NULL::BIGINT AS holder, NULL::VARCHAR AS property, p.o AS object FROM pt7 p JOIN names ON names.v = p.v AND names.x = p.x UNION SELECT v, NULL, o, prop, x FROM cell7""",
    over_programs=True,
)
def rule_points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What variables and properties may be, through aliases and nested properties."""
    return aliases.may_be(corpus(spark, sf_dir))


@query(
    """WITH RECURSIVE free AS (SELECT * FROM n WHERE type <> 'Literal' AND coalesce(name, '') <> 'f'),
fe AS (SELECT e.* FROM e JOIN free a ON a.v = e.v AND a.id = e.s JOIN free b ON b.v = e.v AND b.id = e.d WHERE e.rel NOT IN ('AST', 'FD')),
w AS (SELECT v, id FROM free WHERE type IN ('TAINT_SOURCE', 'CFG_F_START') UNION SELECT w.v, fe.d FROM w JOIN fe ON fe.v = w.v AND fe.s = w.id),
x AS (SELECT free.*, CASE WHEN c.v IS NOT NULL THEN 'darkviolet' WHEN type LIKE 'CFG%' THEN 'red' WHEN type LIKE 'PDG%' THEN 'darkgreen' WHEN type LIKE 'TAINT%' THEN 'goldenrod4' ELSE 'blue' END AS colour FROM free JOIN w ON w.v = free.v AND w.id = free.id LEFT JOIN (SELECT DISTINCT v, callee FROM cg) c ON c.v = free.v AND c.callee = free.id),
y AS (SELECT fe.*, CASE rel WHEN 'CFG' THEN 'red' WHEN 'PDG' THEN 'darkgreen' WHEN 'CG' THEN 'goldenrod3' ELSE 'black' END AS colour FROM fe JOIN w ON w.v = fe.v AND w.id = fe.s)
SELECT DISTINCT v, 0 AS part, 'digraph {' AS line FROM w UNION ALL SELECT DISTINCT v, 3, '}' FROM w
UNION ALL SELECT v, 1, '  ' || id || ' [label="' || concat_ws(' ', id::VARCHAR, type, name) || '" color=' || colour || ' fontcolor=' || colour || '];' FROM x
UNION ALL SELECT v, 2, '  ' || s || ' -> ' || d || ' [label="' || concat_ws(':', rel, r, name) || '" color=' || colour || ' fontcolor=' || colour || ' style=' || CASE WHEN rel IN ('REF', 'SINK') THEN 'dashed' ELSE 'solid' END || '];' FROM y""",
    over_programs=True,
)
def rule_drawing_from_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the control flow and the taint source lead to, without syntax and literals, without what has the name f; functions that are called are marked."""
    graph = corpus(spark, sf_dir)
    called = call_graph(graph).select("package_id", F.col("callee").alias("node"))
    starts = graph.n("TAINT_SOURCE", "CFG_F_START").select("package_id", F.col("node_id").alias("node"))
    return packages.drawing_from(graph, starts, ("AST", "FD", "Literal"), ("f",), called)
