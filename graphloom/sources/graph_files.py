"""Graph files, configs and source text: reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LOCATION, PropertyGraph

SEPARATOR = "¿"
#: The headers of the interchange format, in order.
NODE_COLUMNS = ("Id:ID", "Type", "SubType", "FunctionContext", "IdentifierName", "Raw", "InternalStructure", "Location", "Code", "Label:LABEL")
EDGE_COLUMNS = ("FromId:START_ID", "ToId:END_ID", "RelationLabel:TYPE", "RelationType", "IdentifierName", "ArgumentIndex", "ParamIndex", "StmtIndex", "ElementIndex", "ExpressionIndex", "MethodIndex", "SourceObjName", "IsProp")


def _csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, sep=SEPARATOR, header=True, quote="", escape="", nullValue="", emptyValue="")


def read_graph(spark: SparkSession, nodes: str, edges: str, package_id: str = "main", merge: bool = False) -> PropertyGraph:
    """A graph from node and edge files. Rows without ids are skipped, repeated nodes too, and edges with a missing end. merge keeps one edge, the last in the file's order, for each pair and rel_type."""
    n, e = _csv(spark, nodes, NODE_COLUMNS), _csv(spark, edges, EDGE_COLUMNS)
    node = n.select(
        F.lit(package_id).alias("package_id"), F.col("`Id:ID`").try_cast("long").alias("node_id"), F.coalesce("Type", F.col("`Label:LABEL`")).alias("type"), F.col("SubType").alias("sub_type"), F.col("FunctionContext").try_cast("long").alias("function_context"),
        F.col("IdentifierName").alias("identifier_name"), F.col("Raw").alias("raw"), F.from_json("Location", LOCATION).alias("location"), F.col("Code").alias("code"),
    ).where("node_id is not null").dropDuplicates(["node_id"])

    def number(c: str):
        return F.col(c).try_cast("int")

    edge = e.select(
        F.lit(package_id).alias("package_id"), F.monotonically_increasing_id().alias("edge_id"), F.col("`FromId:START_ID`").try_cast("long").alias("src"), F.col("`ToId:END_ID`").try_cast("long").alias("dst"), F.col("`RelationLabel:TYPE`").alias("rel_type"), F.col("RelationType").alias("relation_type"),
        F.col("IdentifierName").alias("identifier_name"), number("ArgumentIndex").alias("argument_index"), number("ParamIndex").alias("param_index"), (F.col("ParamIndex") == "this").alias("is_this"), number("StmtIndex").alias("stmt_index"), number("ElementIndex").alias("element_index"),
        number("ExpressionIndex").alias("expression_index"), number("MethodIndex").alias("method_index"), F.col("SourceObjName").alias("source_obj_name"), (F.lower("IsProp") == "true").alias("is_prop"),
    ).where("src is not null and dst is not null")
    for end in ("src", "dst"):
        edge = edge.join(node.select(F.col("node_id").alias(end)), end, "left_semi")
    if merge:
        last = edge.groupBy("package_id", "src", "dst", "rel_type").agg(F.max_by(F.struct(*(c for c in edge.columns if c not in ("package_id", "src", "dst", "rel_type"))), "edge_id").alias("r"))
        edge = last.select("package_id", "src", "dst", "rel_type", "r.*").select(*edge.columns)
    return PropertyGraph(node, edge)


def write_graph(graph: PropertyGraph, nodes: str, edges: str, compression: str = "none") -> None:
    """The interchange files; fields are not quoted. compression: as Spark names it, read_graph sees it by the files' names."""
    text = lambda c: F.col(c).cast("string")
    n = graph.nodes.select(text("node_id"), "type", "sub_type", text("function_context"), "identifier_name", F.replace("raw", F.lit('"'), F.lit("'")), F.lit(None).cast("string"), F.to_json("location"), "code", "type").toDF(*NODE_COLUMNS)
    param = F.when(F.col("is_this"), "this").otherwise(text("param_index"))
    e = graph.edges.select(text("src"), text("dst"), "rel_type", "relation_type", "identifier_name", text("argument_index"), param, text("stmt_index"), text("element_index"), text("expression_index"), text("method_index"), "source_obj_name", text("is_prop")).toDF(*EDGE_COLUMNS)
    for df, path in ((n, nodes), (e, edges)):
        df.write.mode("overwrite").csv(path, compression=compression, sep=SEPARATOR, header=True, quote="", escape="", nullValue="", emptyValue="")


def write_parquet(graph: PropertyGraph, folder: str) -> None:
    graph.nodes.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{folder}/edges")


def read_parquet(spark: SparkSession, folder: str) -> PropertyGraph:
    return PropertyGraph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


_SINK = "struct<sink:string,type:string,args:array<int>,packages:array<struct<package:string,args:array<int>>>>"
CONFIG = f"sinks map<string,array<{_SINK}>>, sources array<struct<source:string,type:string,packages:array<string>>>, `functions-signatures` map<string,struct<package:string,args_types:array<string>,`rest?`:boolean>>, prototypes map<string,array<string>>"


def read_config(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """sinks (vuln_type, sink, kind, package, arg, ord), signatures (fn, args_types, rest), prototypes (kind, method) of a JSON config."""
    config = spark.read.schema(CONFIG).json(path, multiLine=True)
    return config_tables(config)


def config_tables(config: DataFrame) -> dict[str, DataFrame]:
    kinds = config.select(F.posexplode(F.map_entries("sinks")).alias("a", "e")).select("a", F.col("e.key").alias("vuln_type"), F.posexplode("e.value").alias("b", "s"))
    sinks = kinds.select("vuln_type", F.col("s.sink").alias("sink"), F.col("s.type").alias("kind"), F.coalesce("s.packages", F.array(F.struct(F.lit(None).cast("string").alias("package"), F.col("s.args").alias("args")))).alias("p"), (F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("ord"))
    sinks = sinks.select("vuln_type", "sink", "kind", F.explode("p").alias("p"), "ord").select("vuln_type", "sink", "kind", F.col("p.package").alias("package"), F.explode_outer("p.args").alias("arg"), "ord")
    signatures = config.select(F.explode("functions-signatures").alias("fn", "s")).select("fn", F.col("s.args_types").alias("args_types"), F.col("s.`rest?`").alias("rest"))
    prototypes = config.select(F.explode("prototypes").alias("kind", "m")).select("kind", F.explode("m").alias("method"))
    return {"sinks": sinks, "signatures": signatures, "prototypes": prototypes}


def read_sources(spark: SparkSession, path: str, package_id: str = "main") -> DataFrame:
    """package_id, path, content of source files, without a first line that names an interpreter."""
    files = spark.read.text(path, wholetext=True).select(F.lit(package_id).alias("package_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return files.withColumn("content", F.regexp_replace("content", r"^#!.*\r?\n", "\n"))


def source_lines(sources: DataFrame) -> DataFrame:
    """package_id, path, lineno (from 1), line."""
    return sources.select("package_id", "path", F.posexplode(F.split("content", "\n")).alias("n", "line")).select("package_id", "path", (F.col("n") + 1).alias("lineno"), F.regexp_replace("line", r"\r$", "").alias("line"))
