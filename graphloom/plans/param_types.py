"""Structure and types of parameters, inferred from how their names and objects are used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..operators.closure import SMALL, checkpointed, reach
from ..operators.match import exists, hop, label, start, union
from ..operators.regular import prefixes
from .flow import CALL, OBJECT

#: Operators that only numbers take.
NUMERIC = ("*", "-", "/", "**", "%", ">", "<", ">=", "<=")
COMPARED = ("==", "===")


def parameter_name(object_name: Column) -> Column:
    """The source name in an object's name <context>.<name>-o<n>; argv stays argv."""
    return F.when(object_name.contains("argv"), "argv").otherwise(F.get(F.split(F.get(F.split(object_name, r"\."), F.lit(1)), "-"), F.lit(0)))


def parameter_prefixes(graph: PropertyGraph, functions: DataFrame, small: int = SMALL) -> DataFrame:
    """package_id, fn, param, param_index, prefix, node: an object that a parameter leads to without entering calls, and the properties read on the way up to the first dependency.

    functions: (package_id, fn). Also over an object that a || of the parameter makes. On a cycle of property reads an
    object is opened under its first prefix, others are leaves (see regular.prefixes); a property without a name is *.
    """
    param = hop(graph, functions.select("package_id", "fn"), "fn", "node", "REF", "param", keep={"param_index": "param_index", "is_this": "is_this"})
    param = label(graph, param, "node", OBJECT, keep={"object_name": "identifier_name"}).where("not coalesce(is_this, false)")
    param = param.select("package_id", "fn", parameter_name(F.col("object_name")).alias("param"), "param_index", "node").where("param <> 'this'")
    made = hop(graph, start(graph, "statement", "ExpressionStatement"), "statement", "assignment", "AST")
    made = label(graph, hop(graph, label(graph, made, "assignment", "AssignmentExpression"), "assignment", "right", "AST"), "right", "LogicalExpression")
    made = hop(graph, made, "statement", "other", "REF").select("package_id", "other").distinct()
    one = hop(graph, param, "node", "other", "PDG", "DEP")
    two = hop(graph, hop(graph, param, "node", "between", "PDG", "ARG"), "between", "other", "PDG", "DEP").drop("between")
    others = exists(union(one, two), made, "other").drop("node").withColumnRenamed("other", "node")
    origin = F.struct("fn", "param", "param_index")
    seeds = union(param, others).select("package_id", F.to_json(origin).alias("origin"), "node")
    kind = F.when(F.col("relation_type") == "SO", "read").when(F.col("relation_type") == "DEP", "end").otherwise("stay")
    edges = graph.e("PDG").where(~F.coalesce(F.col("relation_type") == "ARG", F.lit(False))).select("package_id", "src", "dst", kind.alias("kind"), F.col("identifier_name").alias("name"))
    found = prefixes(edges, seeds, small).withColumn("o", F.from_json("origin", "fn long, param string, param_index int"))
    return found.select("package_id", "o.fn", "o.param", "o.param_index", "prefix", "node")


def parameter_trees(graph: PropertyGraph, functions: DataFrame, small: int = SMALL) -> DataFrame:
    """package_id, fn, param, param_index, prefix, ids: the objects under each prefix (see parameter_prefixes), in order."""
    found = parameter_prefixes(graph, functions, small)
    return found.groupBy("package_id", "fn", "param", "prefix").agg(F.min("param_index").alias("param_index"), F.array_sort(F.collect_set("node")).alias("ids"))


def names_of(graph: PropertyGraph, trees: DataFrame) -> DataFrame:
    """package_id, fn, param, prefix, name, first: the name of each node of the trees (first) and of the declarators that refer to its objects."""
    key = ("package_id", "fn", "param", "prefix")
    own = trees.select(*key, F.coalesce(F.try_element_at("prefix", F.lit(-1)), F.col("param")).alias("name"), F.lit(True).alias("first"))
    objects = trees.select(*key, F.explode("ids").alias("obj"))
    alias = label(graph, hop(graph, objects, "obj", "declarator", "REF", reverse=True), "declarator", "VariableDeclarator", keep={"name": "identifier_name"})
    return own.unionByName(alias.select(*key, "name", F.lit(False).alias("first")).distinct())


def uses(graph: PropertyGraph, sinks: DataFrame, signatures: DataFrame, prototypes: DataFrame) -> DataFrame:
    """package_id, name, first_only, type: what each use of an identifier says about its type; names are not scoped."""
    ids = graph.n("Identifier").select("package_id", F.col("node_id").alias("id"), F.col("identifier_name").alias("name"))
    parent = hop(graph, ids, "id", "parent", "AST", reverse=True, keep={"role": "relation_type", "position": "argument_index"})
    parent = checkpointed(label(graph, parent, "parent", keep={"kind": "type", "operator": "sub_type"}))
    words = lambda found, v, as_: label(graph, found, v, "Identifier", keep={as_: "identifier_name"})

    def says(found: DataFrame, type_: Column | str, first_only: bool = False) -> DataFrame:
        return found.select("package_id", "name", F.lit(first_only).alias("first_only"), (F.lit(type_) if isinstance(type_, str) else type_).alias("type"))

    argument = parent.where("kind = 'CallExpression' and role = 'arg'")
    member = label(graph, hop(graph, argument, "parent", "member", "AST"), "member", "MemberExpression")
    static = words(hop(graph, member, "member", "object", "AST", "object"), "object", "owner").where(F.col("owner").isin("Array", "Number", "Object"))
    called = words(hop(graph, argument, "parent", "function", "AST"), "function", "fn").join(signatures, "fn")
    taken = F.when(F.col("position") <= F.size("args_types"), F.get("args_types", F.col("position") - 1)).when(F.col("rest"), F.get("args_types", F.lit(0)))
    operand = parent.where("kind = 'BinaryExpression'")
    literal = label(graph, hop(graph, operand, "parent", "constant", "AST"), "constant", "Literal", keep={"literal": "sub_type"})
    typeof = label(graph, hop(graph, parent.where("kind = 'UnaryExpression' and operator = 'typeof'"), "parent", "declarator", "AST", reverse=True), "declarator", "VariableDeclarator", keep={"held": "identifier_name"})
    compared = operand.where(F.col("operator").isin(*COMPARED) & (F.col("role") == "left")).select("package_id", "parent", F.col("name").alias("held"))
    compared = label(graph, hop(graph, compared, "parent", "constant", "AST", "right"), "constant", "Literal", keep={"raw": "raw"}).select("package_id", "held", "raw")
    typeof = typeof.join(compared, ["package_id", "held"])
    receiver = hop(graph, parent.where("kind = 'MemberExpression' and role = 'object'"), "parent", "call", "AST", reverse=True)
    receiver = words(hop(graph, label(graph, receiver, "call", "CallExpression"), "parent", "property", "AST", "property"), "property", "method").join(prototypes.withColumnRenamed("kind", "of"), "method")
    names = sinks.select(F.col("sink").alias("callee_name")).distinct()
    first_arg = parent.where("kind in ('CallExpression', 'NewExpression') and role = 'arg' and position = 1")
    callee = hop(graph, first_arg, "parent", "callee", "AST", "callee")
    plain = words(callee, "callee", "callee_name").join(names, "callee_name", "left_semi")
    deep = words(hop(graph, label(graph, callee.where("kind = 'CallExpression'"), "callee", "MemberExpression"), "callee", "property", "AST", "property"), "property", "callee_name").join(names, "callee_name", "left_semi")
    found = [
        says(static, F.lower("owner")),
        says(called.withColumn("t", taken).where("t is not null"), F.col("t")),
        says(typeof, F.replace("raw", F.lit("'"), F.lit(""))),
        says(parent.where("kind = 'CallExpression' and role = 'callee'"), "function", True),
        says(receiver.where("of = 'array'"), "array"),
        says(parent.where("kind = 'ForOfStatement' and role = 'right'"), "array"),
        says(literal.where(F.col("operator").isin(*COMPARED) & (F.col("literal") == "boolean")), "bool"),
        says(literal.where("literal = 'number'"), "number"),
        says(operand.where(F.col("operator").isin(*NUMERIC)), "number"),
        says(receiver.where("of = 'string'"), "string", True),
        says(literal.where("operator in ('+', '==') and literal = 'string'"), "string"),
        says(parent.where("kind = 'TemplateLiteral'"), "string", True),
        says(plain, "string"),
        says(deep, "string"),
        says(parent.where("kind = 'MemberExpression' and operator = 'computed' and role = 'property'"), "string"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def inferred(graph: PropertyGraph, trees: DataFrame, sinks: DataFrame, signatures: DataFrame, prototypes: DataFrame) -> DataFrame:
    """package_id, fn, param, prefix, types (sorted; none: any; called under its own name: function alone)."""
    key = ["package_id", "fn", "param", "prefix"]
    names = names_of(graph, trees)
    said = names.join(uses(graph, sinks, signatures, prototypes), ["package_id", "name"]).where("first or not first_only")
    types = said.groupBy(*key).agg(F.array_sort(F.collect_set("type")).alias("types"), F.bool_or((F.col("type") == "function") & F.col("first_only")).alias("called"))
    own = F.when(F.col("called"), F.array(F.lit("function"))).otherwise(F.coalesce("types", F.array(F.lit("any"))))
    return trees.select(*key, "param_index").join(types, key, "left").select(*key, "param_index", own.alias("types"))


def folded(types: Column) -> Column:
    """No type: any; one: itself; more: a union, as JSON."""
    return F.when(F.size(types) == 0, F.lit('"any"')).when(F.size(types) == 1, F.concat(F.lit('"'), types[0], F.lit('"'))).otherwise(F.concat(F.lit('{"_union":'), F.to_json(types), F.lit("}")))


def arguments_dependency(graph: PropertyGraph, values: DataFrame) -> DataFrame:
    """package_id, value, param_name: parameters through which the arguments object of a caller reaches a value (package_id, value)."""
    pdg = graph.e("PDG").select("package_id", "src", "dst")
    held = hop(graph, start(graph, "args", OBJECT, where=F.col("identifier_name").contains("arguments-")), "args", "slot", "PDG", None, "*")
    held = label(graph, held, "slot", OBJECT)
    there = reach(pdg, held.select("package_id", F.col("slot").alias("origin"), F.col("slot").alias("node")).distinct(), 0).select("package_id", F.col("node").alias("arg")).distinct()
    found = label(graph, hop(graph, label(graph, there, "arg", OBJECT), "arg", "call", "PDG", "ARG"), "call", CALL)
    found = label(graph, hop(graph, hop(graph, found, "call", "func", "CG"), "func", "param", "REF", "param"), "param", OBJECT, keep={"param_name": "identifier_name"})
    back = reach(pdg, values.select("package_id", F.col("value").alias("origin"), F.col("value").alias("node")), 0, backward=True).withColumnsRenamed({"origin": "value", "node": "param"})
    return found.join(back, ["package_id", "param"]).select("package_id", "value", "param_name").distinct()


def value_dependencies(graph: PropertyGraph, values: DataFrame) -> DataFrame:
    """package_id, value, args: arguments of the calls whose results the values (package_id, value) are."""
    found = label(graph, hop(graph, values, "value", "call", "PDG", "RET", reverse=True), "call", CALL)
    found = label(graph, hop(graph, found, "call", "arg", "PDG", "ARG", reverse=True), "arg", OBJECT)
    return found.groupBy("package_id", "value").agg(F.array_sort(F.collect_set("arg")).alias("args"))
