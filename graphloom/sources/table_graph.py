"""Relational tables as a property graph.

Node ids are a type's number times 10^17 plus the key; items and turns have their owner's key times a fixed
factor plus their number, and a number beyond the factor is an error. A package is the part of the graph that hangs
together by one owner: a customer's orders and items, a user's events, a conversation, and the region tree. Edges
carry the types of their ends, so that a test of a type prunes the union of the edge kinds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph

UNIT = 10**17
ITEMS, TURNS = 1000, 1_000_000
TYPES = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "LineItem": 7, "Event": 8, "Turn": 9}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: Column) -> Column:
    return (F.lit(TYPES[kind] * UNIT) + key.cast("long")).alias("node_id")


def _numbered(owner: Column, number: Column, factor: int) -> Column:
    ok = (number >= 0) & (number < factor) & (owner.cast("long") < UNIT // factor)
    return F.when(ok, owner.cast("long") * factor + number).when(owner.isNotNull() & number.isNotNull(), F.raise_error(F.lit("a key is too large for a node id")).cast("long"))


def item_key() -> Column:
    return _numbered(F.col("l_orderkey"), F.col("l_linenumber"), ITEMS)


def _edge(df: DataFrame, package: Column, src: Column, dst: Column, kinds: str, rel: str, relation: str | None = None, name: Column | None = None) -> DataFrame:
    text = F.lit(None).cast("string")
    a, b = kinds.split()
    return df.select(package.cast("string").alias("package_id"), src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel_type"), (F.lit(relation) if relation else text).alias("relation_type"), (text if name is None else name).alias("identifier_name"), F.lit(a).alias("src_type"), F.lit(b).alias("dst_type"))


def table_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """AST child: region, nation, customer or supplier. PDG SO: customer, order, line item; NV: an order to the customer's next; DEP: part and supplier to item. CFG: an event or turn to the next."""
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    orders, items = t("orders"), t("lineitem")
    owned = items.join(orders.select(c("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    by_customer = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    next_order = orders.withColumn("next", F.lead("o_orderkey").over(by_customer)).where("next is not null")
    next_event = t("events").withColumn("next", F.lead("event_id").over(by_user)).where("next is not null")
    turn = t("conversations").withColumn("key", _numbered(c("conv_id"), c("turn"), TURNS))
    following = turn.select(c("conv_id"), (c("turn") - 1).alias("turn")).distinct()
    next_turn = turn.join(following, ["conv_id", "turn"], "left_semi")
    tree, user, conv = F.lit("tree"), F.concat(F.lit("user-"), c("user_id")), F.concat(F.lit("conv-"), c("conv_id"))
    edges = [
        _edge(t("nation"), tree, node("Region", c("n_regionkey")), node("Nation", c("n_nationkey")), "Region Nation", "AST", "child"),
        _edge(t("customer"), tree, node("Nation", c("c_nationkey")), node("Customer", c("c_custkey")), "Nation Customer", "AST", "child"),
        _edge(t("supplier"), tree, node("Nation", c("s_nationkey")), node("Supplier", c("s_suppkey")), "Nation Supplier", "AST", "child"),
        _edge(orders, c("o_custkey"), node("Customer", c("o_custkey")), node("Order", c("o_orderkey")), "Customer Order", "PDG", "SO", c("o_orderpriority")),
        _edge(owned, c("o_custkey"), node("Order", c("l_orderkey")), node("LineItem", item_key()), "Order LineItem", "PDG", "SO", c("l_returnflag")),
        _edge(next_order, c("o_custkey"), node("Order", c("o_orderkey")), node("Order", c("next")), "Order Order", "PDG", "NV"),
        _edge(owned, c("o_custkey"), node("Part", c("l_partkey")), node("LineItem", item_key()), "Part LineItem", "PDG", "DEP"),
        _edge(owned, c("o_custkey"), node("Supplier", c("l_suppkey")), node("LineItem", item_key()), "Supplier LineItem", "PDG", "DEP"),
        _edge(next_event, user, node("Event", c("event_id")), node("Event", c("next")), "Event Event", "CFG"),
        _edge(next_turn, conv, node("Turn", c("key")), node("Turn", c("key") + 1), "Turn Turn", "CFG"),
    ]

    def kind(df: DataFrame, name: str, package: Column, key: Column, label: Column) -> DataFrame:
        return df.select(package.cast("string").alias("package_id"), node(name, key), F.lit(name).alias("type"), label.cast("string").alias("identifier_name"))

    nodes = [
        kind(t("region"), "Region", tree, c("r_regionkey"), c("r_name")),
        kind(t("nation"), "Nation", tree, c("n_nationkey"), c("n_name")),
        kind(t("customer"), "Customer", tree, c("c_custkey"), c("c_name")),
        kind(t("supplier"), "Supplier", tree, c("s_suppkey"), c("s_name")),
        kind(t("part"), "Part", tree, c("p_partkey"), c("p_name")),
        kind(orders, "Order", c("o_custkey"), c("o_orderkey"), c("o_orderstatus")),
        kind(owned, "LineItem", c("o_custkey"), item_key(), c("l_returnflag")),
        kind(t("events"), "Event", user, c("event_id"), c("event_type")),
        kind(turn, "Turn", conv, c("key"), c("role")),
    ]
    names = ("package_id", "src", "dst", "rel_type", "relation_type", "identifier_name", "src_type", "dst_type")
    return PropertyGraph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, [e.select(*names) for e in edges]))
