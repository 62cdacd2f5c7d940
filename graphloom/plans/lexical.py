"""Program graphs from source text, by token tables.

A subset of the language is read with regular expressions, windows and joins only: function declarations and
expressions, calls (also nested and on members), assignments, returns and exports. Tokens of a file carry their
line and nesting depths (running sums); an opening bracket's partner is the next one at its depth. What a statement
reads flows to what it assigns or returns, arguments flow into calls and their results out. Names belong to the
innermost function around them that has them as a parameter or assigns them. There are no branches, no classes, no
destructuring and no modules: functions are known by name in their package.

Ids are positions, so a package's node ids do not depend on how rows are dealt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import EDGES, NODES, PropertyGraph
from ..operators.closure import checkpointed

_TOKEN = r"""//[^\n]*|/\*[\s\S]*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\d[\w.]*|=>|[=!]==?|[<>]=|&&|\|\||[-+*/%]=|[^\s]|\n"""
_NAME = r"^[A-Za-z_$][\w$]*$"
_WORDS = ("function", "return", "const", "let", "var", "if", "else", "for", "while", "do", "new", "typeof", "in", "of", "this", "null", "true", "false", "undefined", "await", "switch", "case", "break", "continue", "try", "catch", "finally", "throw", "module", "exports", "require", "delete", "void", "yield", "default", "class")
_FILE = ["package_id", "path"]
_UNIT = 10  # ids for each token
_FILES = 10**9  # ids for each file of a package


def tokens(files: DataFrame) -> DataFrame:
    """package_id, path, pos, token, line, file_no, and depths before the token: round (also square) and curly; statement: breaks before it."""
    number = files.select(*_FILE).distinct().withColumn("file_no", F.row_number().over(Window.partitionBy("package_id").orderBy("path")))
    raw = files.select(*_FILE, F.posexplode(F.regexp_extract_all("content", F.lit(_TOKEN), F.lit(0))).alias("pos", "token")).join(number, [*_FILE])
    before = Window.partitionBy(*_FILE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(*_FILE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda what, w: F.coalesce(F.sum(what).over(w), F.lit(0))
    one = lambda *t: F.col("token").isin(*t).cast("int")
    comment = F.col("token").startswith("//") | F.col("token").startswith("/*")
    rows = raw.withColumn("line", 1 + count(F.length(F.regexp_replace("token", r"[^\n]", "")), before))
    rows = rows.withColumn("round", count(one("(", "[") - one(")", "]"), before)).withColumn("curly", count(one("{") - one("}"), before))
    rows = rows.withColumn("statement", count(F.when((F.col("token") == "\n") & (F.col("round") == 0), 1).otherwise(one(";", "{", "}")), through))
    return rows.where(~comment & (F.col("token") != "\n"))


def _pairs(t: DataFrame, opening: str, closing: str, depth: str) -> DataFrame:
    """package_id, path, open, close of brackets."""
    level = F.col(depth) - F.when(F.col("token") == closing, 1).otherwise(0)
    own = t.where(F.col("token").isin(opening, closing)).select(*_FILE, "pos", "token", level.alias("level"))
    partner = F.lead("pos").over(Window.partitionBy(*_FILE, "level").orderBy("pos"))
    return own.withColumn("close", partner).where(F.col("token") == opening).select(*_FILE, F.col("pos").alias("open"), "close").where("close is not null")


def program_graph(files: DataFrame, sinks: DataFrame, tainted: str = "exported") -> PropertyGraph:
    """The graph of files (package_id, path, content) with the sinks (sink, arg) of a config. tainted: parameters of "exported" functions, or "all"."""
    order = Window.partitionBy(*_FILE).orderBy("pos")
    later = Window.partitionBy(*_FILE).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    t = tokens(files)
    t = t.withColumns({"prev": F.lag("token").over(order), "prev2": F.lag("token", 2).over(order), "next": F.lead("token").over(order), "next_round": F.last(F.when(F.col("token") == "(", F.col("pos")), True).over(later), "next_curly": F.last(F.when(F.col("token") == "{", F.col("pos")), True).over(later)})
    t = checkpointed(t.withColumn("is_name", F.col("token").rlike(_NAME) & ~F.col("token").isin(*_WORDS)))
    node_id = lambda pos, k: (F.col("file_no") * _FILES + pos * _UNIT + k).cast("long")
    rounds, curlies = _pairs(t, "(", ")", "round"), _pairs(t, "{", "}", "curly")

    f = t.where("token = 'function'").withColumn("name", F.when(F.col("next").rlike(_NAME), F.col("next")).when(F.col("prev").isin("=", ":"), F.col("prev2")).otherwise(F.concat(F.lit("anon"), F.col("pos").cast("string"))))
    f = f.join(rounds.withColumnsRenamed({"open": "next_round", "close": "params_close"}), [*_FILE, "next_round"]).select(*_FILE, "file_no", F.col("pos").alias("fn"), "name", F.col("line").alias("fn_line"), F.col("next_round").alias("params_open"), "params_close")
    f = f.join(t.select(*_FILE, F.col("pos").alias("params_close"), F.col("next_curly").alias("open")), [*_FILE, "params_close"]).join(curlies, [*_FILE, "open"]).withColumnRenamed("close", "body_close")
    f = checkpointed(f)
    inside = checkpointed(f.select(*_FILE, "fn", "params_open", F.explode(F.sequence("params_open", "body_close")).alias("pos")))
    owner = inside.groupBy(*_FILE, "pos").agg(F.max("fn").alias("owner"))
    t = checkpointed(t.join(owner, [*_FILE, "pos"], "left").withColumn("owner", F.coalesce("owner", F.lit(-1))))

    # names: parameters and assigned variables, and the function that each use belongs to
    params = t.join(f.select(*_FILE, "fn", "params_open", "params_close"), _FILE).where("is_name and owner = fn and pos > params_open and pos < params_close")
    params = params.select(*_FILE, "file_no", "fn", F.col("token").alias("name"), "pos").withColumn("nth", F.row_number().over(Window.partitionBy(*_FILE, "fn").orderBy("pos")))
    params = checkpointed(params)
    targets = t.where("is_name and next = '=' and not (prev <=> '.')").select(*_FILE, "statement", F.col("owner").alias("fn"), F.col("token").alias("name"), "pos", "file_no")
    declared = params.select(*_FILE, "fn", "name", "pos").unionByName(targets.select(*_FILE, "fn", "name", "pos")).groupBy(*_FILE, "fn", "name").agg(F.min("pos").alias("var"))
    around = inside.select(*_FILE, "pos", "fn").unionByName(t.select(*_FILE, "pos", F.lit(-1).alias("fn")))
    uses = t.where("is_name and not (prev <=> '.')").select(*_FILE, "pos", F.col("token").alias("name"))
    uses = uses.join(around, [*_FILE, "pos"]).join(declared, [*_FILE, "fn", "name"]).groupBy(*_FILE, "pos").agg(F.max_by("var", "fn").alias("var"))

    # calls: arguments by commas at the depth inside the brackets; what is in no call's brackets belongs to the statement
    c = t.where("is_name and next = '(' and not (prev <=> 'function')").join(rounds.withColumnsRenamed({"open": "next_round", "close": "call_close"}), [*_FILE, "next_round"])
    c = checkpointed(c.select(*_FILE, "file_no", F.col("pos").alias("call"), F.col("token").alias("callee"), F.col("round").alias("call_round"), "next_round", "call_close", "owner", "statement", "line", F.col("prev").eqNullSafe(".").alias("member")))
    within = c.select(*_FILE, "call", "call_round", F.explode(F.sequence(F.col("next_round") + 1, F.col("call_close"))).alias("pos"))
    innermost = within.groupBy(*_FILE, "pos").agg(F.max("call").alias("call"))
    commas = t.where("token = ','").join(innermost, [*_FILE, "pos"]).join(c.select(*_FILE, "call", "call_round"), [*_FILE, "call"]).where("round = call_round + 1").groupBy(*_FILE, "call").agg(F.collect_list("pos").alias("commas"))
    variable = uses.select(*_FILE, "pos", (F.col("var") * _UNIT + 1).alias("value"))
    result = c.select(*_FILE, F.col("call").alias("pos"), (F.col("call") * _UNIT + 4).alias("value"))
    values = variable.join(c.select(*_FILE, F.col("call").alias("pos")), [*_FILE, "pos"], "left_anti").unionByName(result)
    values = checkpointed(values.join(t.select(*_FILE, "file_no", "pos", "statement", "owner"), [*_FILE, "pos"]).join(innermost, [*_FILE, "pos"], "left"))
    nth = 1 + F.size(F.filter(F.coalesce("commas", F.array().cast("array<int>")), lambda x: x < F.col("pos")))
    args = checkpointed(values.where("call is not null").join(commas, [*_FILE, "call"], "left").select(*_FILE, "file_no", "call", "value", nth.alias("nth")))
    loose = values.where("call is null")
    known = c.where("not member").join(f.select("package_id", F.col("path").alias("to_path"), F.col("file_no").alias("to_file"), F.col("name").alias("callee"), F.col("fn").alias("to")), ["package_id", "callee"])

    # exported functions: names after module.exports or exports, in the statement or the braces that follow
    out = t.where("(token = 'exports') and (prev <=> '.' or next = '.' or next = '=')").select(*_FILE, F.col("pos").alias("at"), F.col("statement").alias("of"), "next_curly")
    flat = t.where("is_name").select(*_FILE, "pos", "token", "statement").join(out, _FILE).where("statement = of and pos > at").select(*_FILE, "token")
    braces = out.join(curlies.withColumnsRenamed({"open": "next_curly"}), [*_FILE, "next_curly"]).join(t.select(*_FILE, F.col("pos").alias("next_curly"), "prev", "statement"), [*_FILE, "next_curly"]).where("prev = '=' and statement = of + 1")
    listed = t.where("is_name").select(*_FILE, "pos", "token").join(braces.select(*_FILE, "next_curly", "close"), _FILE).where("pos > next_curly and pos < close").select(*_FILE, "token")
    assigned = t.where("token = 'function'").select(*_FILE, "pos", "statement").join(out, _FILE).where("statement = of and pos > at").select(*_FILE, F.col("pos").alias("fn"))
    exported = f.join(flat.unionByName(listed).withColumnRenamed("token", "name").distinct(), [*_FILE, "name"], "left_semi").select(*_FILE, "fn").unionByName(assigned).distinct()

    own = lambda col, k: node_id(F.col(col), F.lit(k))
    place = lambda line: F.struct(F.struct(F.col(line).cast("int").alias("line"), F.lit(0).alias("column")).alias("start"), F.struct(F.col(line).cast("int").alias("line"), F.lit(0).alias("column")).alias("end"), F.col("path").alias("fname"))
    blank = F.lit(None).cast("string")

    def rows(df: DataFrame, schema: str, **columns: Column) -> DataFrame:
        return df.select(*(columns[k.name].cast(k.dataType).alias(k.name) if k.name in columns else F.lit(None).cast(k.dataType).alias(k.name) for k in StructType.fromDDL(schema)))

    package = F.col("package_id")

    def node(df: DataFrame, id_: Column, kind: str, name: Column = blank, location: Column | None = None, context: Column | None = None) -> DataFrame:
        more = ({} if location is None else {"location": location}) | ({} if context is None else {"function_context": context})
        return rows(df, NODES, package_id=package, node_id=id_, type=F.lit(kind), identifier_name=name, **more)

    def edge(df: DataFrame, src: Column, dst: Column, rel: str, relation: str | None = None, name: Column = blank, **more: Column) -> DataFrame:
        return rows(df, EDGES, package_id=package, src=src, dst=dst, rel_type=F.lit(rel), relation_type=F.lit(relation) if relation else blank, identifier_name=name, **more)

    in_function = F.when(F.col("owner") >= 0, node_id(F.col("owner"), F.lit(2))).otherwise(F.col("file_no") * _FILES + 9)
    value = lambda col="value": (F.col("file_no") * _FILES + F.col(col)).cast("long")
    where = dict(context=in_function)
    vars_ = declared.join(t.select(*_FILE, "file_no", F.col("pos").alias("var")), [*_FILE, "var"])
    object_name = F.concat(F.col("fn").cast("string"), F.lit("."), F.col("name"), F.lit("-o"), F.col("var").cast("string"))
    first = sinks.select(F.col("sink").alias("callee"), F.col("arg").alias("nth")).distinct()
    hits = c.join(first.select("callee").distinct(), "callee", "left_semi")
    hit_args = args.join(hits.select(*_FILE, "call", "callee"), [*_FILE, "call"]).join(first, ["callee", "nth"])
    hits = hits.join(hit_args.select(*_FILE, "call").distinct(), [*_FILE, "call"], "left_semi")
    returned = t.where("token = 'return'").select(*_FILE, "statement", "owner", F.col("pos").alias("ret"), "file_no")
    mains = files.select("package_id").distinct().withColumn("file_no", F.lit(0))
    param_name = params.select("package_id", F.col("path").alias("to_path"), F.col("fn").alias("to"), "nth", F.concat(F.col("fn").cast("string"), F.lit("."), F.col("name"), F.lit("-o"), F.col("pos").cast("string")).alias("param"))
    passed = args.join(known.select(*_FILE, "call", "to_path", "to"), [*_FILE, "call"], "left").join(param_name, ["package_id", "to_path", "to", "nth"], "left")
    nodes = [
        node(f, own("fn", 0), "VariableDeclarator", F.col("name")), node(f, own("fn", 1), "FunctionExpression", F.col("name"), place("fn_line")), node(f, own("fn", 2), "CFG_F_START", F.col("name")),
        node(t.select(*_FILE, "file_no").distinct(), (F.col("file_no") * _FILES + 9).cast("long"), "CFG_F_START", F.lit("__main__")), node(mains, F.lit(1).cast("long"), "TAINT_SOURCE", F.lit("TAINT_SOURCE")),
        node(vars_, node_id(F.col("var"), F.lit(1)), "PDG_OBJECT", object_name), node(c, own("call", 4), "PDG_OBJECT", F.concat(F.col("owner").cast("string"), F.lit(".v-o"), F.col("call").cast("string"))),
        node(c, own("call", 3), "PDG_CALL", F.col("callee"), **where), node(c, own("call", 5), "VariableDeclarator", **where), node(c, own("call", 6), "CallExpression", location=place("line")), node(hits, own("call", 7), "TAINT_SINK", F.col("callee")), node(returned, own("ret", 0), "PDG_RETURN"),
    ]
    inner = params if tainted == "all" else params.join(exported, [*_FILE, "fn"], "left_semi")
    edges = [
        edge(f, own("fn", 0), own("fn", 1), "AST", "init"), edge(f, own("fn", 0), own("fn", 2), "FD", "FD"), edge(f, own("fn", 1), own("fn", 2), "FD", "FD"),
        edge(params, own("fn", 0), own("pos", 1), "REF", "param", param_index=F.col("nth") - 1), edge(inner, F.lit(1).cast("long"), own("pos", 1), "PDG", "TAINT"),
        edge(c.where("owner >= 0"), own("owner", 0), own("call", 3), "REF", "call"), edge(c, own("call", 5), own("call", 3), "REF", "obj"), edge(c, own("call", 5), own("call", 6), "AST", "init"), edge(c, own("call", 3), own("call", 4), "PDG", "RET"), edge(c, own("call", 5), own("call", 4), "REF", "obj"),
        edge(known, own("call", 3), (F.col("to_file") * _FILES + F.col("to") * _UNIT).cast("long"), "CG", "CG"), edge(known, own("call", 5), (F.col("to_file") * _FILES + F.col("to") * _UNIT).cast("long"), "CG", "CG"),
        edge(passed, value(), own("call", 3), "PDG", "ARG", F.coalesce("param", F.lit("undefined"))), edge(hit_args, value(), own("call", 7), "PDG", "DEP"), edge(hits, own("call", 5), own("call", 7), "SINK", "SINK"),
        edge(loose.join(targets.select(*_FILE, "statement", F.col("pos").alias("target"), "name", "fn"), [*_FILE, "statement"]).where("pos > target").join(declared, [*_FILE, "fn", "name"]), value(), own("var", 1), "PDG", "DEP"),
        edge(loose.join(returned.select(*_FILE, "statement", "owner", "ret"), [*_FILE, "statement", "owner"]).where("pos > ret"), value(), own("ret", 0), "PDG", "DEP"),
    ]
    number = Window.partitionBy("package_id").orderBy("src", "dst", "rel_type", "relation_type", "identifier_name")
    all_edges = reduce(DataFrame.unionByName, edges).distinct().withColumn("edge_id", F.row_number().over(number).cast("long"))
    return PropertyGraph(checkpointed(reduce(DataFrame.unionByName, nodes)), checkpointed(all_edges.select(*StructType.fromDDL(EDGES).names)))
