"""What variables and properties of a program may be, from its syntax trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..operators.closure import SMALL, checkpointed
from ..operators.match import hop, label, optional, start, union
from ..operators.points_to import points_to


def variables(graph: PropertyGraph) -> DataFrame:
    """package_id, name, variable: the smallest node that names it; names are not scoped."""
    named = start(graph, "node", "Identifier", "VariableDeclarator", keep={"name": "identifier_name"}).where("name is not null")
    return named.groupBy("package_id", "name").agg(F.min("node").alias("variable"))


def statements(graph: PropertyGraph) -> DataFrame:
    """package_id, kind, target, source, property for points_to: object literals, declarations and assignments to names and properties, and reads of properties, each expression a variable of its own."""
    names = checkpointed(variables(graph))
    values = start(graph, "node", "Identifier", "MemberExpression", "ObjectExpression", keep={"name": "identifier_name", "kind": "type"})
    values = values.join(names, ["package_id", "name"], "left").select("package_id", "node", F.when(F.col("kind") == "Identifier", F.col("variable")).otherwise(F.col("node")).alias("value"))
    values = checkpointed(values.where("value is not null"))
    value_of = lambda found, c, to: found.join(values.select("package_id", F.col("node").alias(c), F.col("value").alias(to)), ["package_id", c])

    member = start(graph, "member", "MemberExpression", keep={"how": "sub_type"})
    member = value_of(hop(graph, member, "member", "base", "AST", "object"), "base", "owner")
    member = optional(graph, member, "member", "at", "AST", "property").join(graph.nodes.select("package_id", F.col("node_id").alias("at"), F.col("type").alias("at_type"), F.col("identifier_name").alias("at_name"), "raw"), ["package_id", "at"], "left")
    literal = F.regexp_replace("raw", "^['\"]|['\"]$", "")
    prop = F.when(F.col("at_type") == "Literal", literal).when(F.col("how") == "computed", "*").otherwise(F.coalesce("at_name", F.lit("*")))
    member = checkpointed(member.select("package_id", "member", "owner", prop.alias("property")).distinct())

    made = start(graph, "node", "ObjectExpression")
    declared = value_of(hop(graph, start(graph, "declarator", "VariableDeclarator", keep={"name": "identifier_name"}), "declarator", "right", "AST", "init"), "right", "from")
    declared = declared.join(names, ["package_id", "name"])
    assigned = hop(graph, hop(graph, start(graph, "assignment", "AssignmentExpression"), "assignment", "left", "AST", "left"), "assignment", "right", "AST", "right")
    assigned = checkpointed(value_of(assigned, "right", "from"))
    to_name = label(graph, assigned, "left", "Identifier", keep={"name": "identifier_name"}).join(names, ["package_id", "name"])
    to_member = assigned.join(member.withColumnRenamed("member", "left"), ["package_id", "left"])

    def rows(found: DataFrame, kind: str, target: str, source: str, property_: Column | None = None) -> DataFrame:
        return found.select("package_id", F.lit(kind).alias("kind"), F.col(target).alias("target"), F.col(source).alias("source"), (F.lit(None).cast("string") if property_ is None else property_).alias("property"))

    parts = [rows(made, "new", "node", "node"), rows(declared, "copy", "variable", "from"), rows(to_name, "copy", "variable", "from"), rows(to_member, "write", "owner", "from", F.col("property")), rows(member, "read", "member", "owner", F.col("property"))]
    return reduce(DataFrame.unionByName, parts).distinct()


def may_be(graph: PropertyGraph, small: int = SMALL) -> DataFrame:
    """package_id, name, holder, property, object: which object literals a variable (name), or a property of an object (holder), may be."""
    found = points_to(statements(graph), small)
    named = found.where("property is null").withColumnRenamed("holder", "variable").join(variables(graph), ["package_id", "variable"])
    one = named.select("package_id", "name", F.lit(None).cast("long").alias("holder"), "property", "object")
    cells = found.where("property is not null").select("package_id", F.lit(None).cast("string").alias("name"), "holder", "property", "object")
    return union(one, cells)
