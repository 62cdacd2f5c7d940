"""Queries of the graph engine over the tables, with their SQL.

Each applies operators of this package to the property graph of ``sources.table_graph`` (or to text columns, for
scalar functions and sources) and has an equal SQL statement over the plain tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions import text
from .model import EDGES, NODES, PropertyGraph
from .operators.closure import paths, reach, reached, shared_folder
from .operators.match import ends, exists, first_match, hop, label, missing, optional, single, start, union
from .plans.detect import vulnerability_types
from .plans.lexical import program_graph
from .sources.graph_files import read_graph, source_lines, write_graph
from .sources.table_graph import TYPES, UNIT, item_key, node, table, table_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The graph's orders, items and version edges in SQL.
CHAIN = """nv AS (SELECT o_custkey AS c, o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders),
v AS (SELECT * FROM nv WHERE dst IS NOT NULL)"""
STEPS = """nx AS (SELECT user_id AS u, event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
s AS (SELECT nx.*, a.event_type AS src_type, b.event_type AS dst_type FROM nx JOIN events a ON a.event_id = nx.src JOIN events b ON b.event_id = nx.dst)"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def key_of(column: str, kind: str):
    return (F.col(column) - F.lit(TYPES[kind] * UNIT)).cast("long")


def version_edges(graph: PropertyGraph) -> DataFrame:
    return graph.e("PDG", "NV").select("package_id", "src", "dst")


# joins ---------------------------------------------------------------------------------------


@query("SELECT r_name AS region, count(*) AS n_orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def path_fixed_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(:Region)-[:AST]->(:Nation)-[:AST]->(:Customer), then its orders, which are in the customer's own package."""
    g = table_graph(spark, sf_dir)
    found = hop(g, start(g, "r", "Region", keep={"region": "identifier_name"}), "r", "n", "AST", "child", types=["Nation"])
    found = hop(g, found, "n", "c", "AST", "child", types=["Customer"]).select("region", "c")
    orders = ends(g, g.e("PDG", "SO"), dst=["Order"]).select(F.col("src").alias("c"))
    return found.join(orders, "c").groupBy("region").agg(F.count("*").alias("n_orders"))


@query("SELECT n_name AS nation, count(DISTINCT l_orderkey * 1000 + l_linenumber) AS n_items FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def path_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(:LineItem)<-[:DEP]-(:Supplier)<-[:AST]-(:Nation)."""
    g = table_graph(spark, sf_dir)
    up = hop(g, start(g, "n", "Nation", keep={"nation": "identifier_name"}), "n", "s", "AST", "child", types=["Supplier"])
    found = ends(g, g.e("PDG", "DEP"), ["Supplier"], ["LineItem"]).select(F.col("dst").alias("i"), F.col("src").alias("s"))
    found = found.join(up.select("s", "nation"), "s")
    return found.select("nation", "i").distinct().groupBy("nation").agg(F.count("*").alias("n_items"))


@query("SELECT n_name AS nation, count(DISTINCT l_orderkey * 1000 + l_linenumber) AS n_items FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def star_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose customer and supplier hang below one nation."""
    g = table_graph(spark, sf_dir)
    tree = hop(g, start(g, "n", "Nation", keep={"nation": "identifier_name"}), "n", "leaf", "AST", "child").select("n", "nation", "leaf")
    found = ends(g, g.e("PDG", "SO"), ["Order"], ["LineItem"]).select("package_id", F.col("src").alias("o"), F.col("dst").alias("i"))
    found = hop(g, found, "o", "c", "PDG", "SO", reverse=True, types=["Customer"])
    found = hop(g, found, "i", "s", "PDG", "DEP", reverse=True, types=["Supplier"]).select("i", "c", "s")
    found = found.join(tree.withColumnRenamed("leaf", "c"), "c").join(tree.select("n", F.col("leaf").alias("s")), ["n", "s"])
    return found.select("nation", "i").distinct().groupBy("nation").agg(F.count("*").alias("n_items"))


@query(f"WITH {CHAIN} SELECT a.o_orderpriority AS priority, count(*) AS n FROM v JOIN orders a ON a.o_orderkey = src JOIN orders b ON b.o_orderkey = dst AND a.o_orderpriority = b.o_orderpriority GROUP BY 1")
def property_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their next versions that the same property leads to."""
    g = table_graph(spark, sf_dir)
    into = lambda v, name: ends(g, g.e("PDG", "SO"), dst=["Order"]).select("package_id", F.col("dst").alias(v), F.col("identifier_name").alias(name))
    found = version_edges(g).join(into("src", "priority"), ["package_id", "src"]).join(into("dst", "priority"), ["package_id", "dst", "priority"])
    return found.groupBy("priority").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS customer, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def optional_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their numbers of orders, none too."""
    g = table_graph(spark, sf_dir)
    own = start(g, "c", "Customer").select(key_of("c", "Customer").cast("string").alias("package_id"), "c")
    found = optional(g, own, "c", "o", "PDG", "SO", types=["Order"])
    return found.groupBy(key_of("c", "Customer").alias("customer")).agg(F.count("o").alias("n_orders"))


@query("SELECT p_partkey AS part FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def exists_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of which an item was returned."""
    g = table_graph(spark, sf_dir)
    # rows of items may share a key, so the flag is taken from the row that names the part
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.lit("tree").alias("package_id"), node("Part", F.col("l_partkey")).alias("p"))
    return exists(start(g, "p", "Part"), returned, "p").select(key_of("p", "Part").alias("part"))


@query("SELECT c_custkey AS customer FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def not_exists_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    g = table_graph(spark, sf_dir)
    own = start(g, "c", "Customer").select(key_of("c", "Customer").cast("string").alias("package_id"), "c")
    return missing(own, ends(g, g.e("PDG", "SO", "1-URGENT"), dst=["Order"]).select("package_id", F.col("src").alias("c")), "c").select(key_of("c", "Customer").alias("customer"))


# paths of any length -----------------------------------------------------------------------------


@query(f"WITH RECURSIVE {CHAIN}, w AS (SELECT c, src, dst FROM v UNION SELECT w.c, w.src, v.dst FROM w JOIN v ON v.src = w.dst) SELECT src AS earlier, count(*) AS n_later FROM w GROUP BY 1")
def varlen_1plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and the numbers of versions after them."""
    g = table_graph(spark, sf_dir)
    e = version_edges(g)
    pairs = reach(e, e.select("package_id", F.col("src").alias("origin"), F.col("src").alias("node")))
    return pairs.groupBy(key_of("origin", "Order").alias("earlier")).agg(F.count("*").alias("n_later"))


@query("SELECT r_name AS region, 'Customer' AS type, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT r_name, 'Supplier', count(*) FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT r_name, 'Nation', count(*) FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT r_name, 'Region', 1 FROM region")
def varlen_0plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs below each region, itself too."""
    g = table_graph(spark, sf_dir)
    seeds = start(g, "origin", "Region").withColumn("node", F.col("origin"))
    found = reach(g.e("AST", "child"), seeds, min_hops=0)
    named = label(g, label(g, found, "origin", "Region", keep={"region": "identifier_name"}), "node", keep={"type": "type"})
    return named.groupBy("region", "type").agg(F.count("*").alias("n"))


@query(f"WITH {STEPS} SELECT a.src AS origin, a.dst AS reached FROM s a UNION SELECT a.src, b.dst FROM s a JOIN s b ON b.src = a.dst")
def varlen_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and those one or two steps after them."""
    g = table_graph(spark, sf_dir)
    e = ends(g, g.e("CFG"), src=["Event"]).select("package_id", "src", "dst")
    found = reach(e, e.select("package_id", F.col("src").alias("origin"), F.col("src").alias("node")), max_hops=2)
    return found.select(key_of("origin", "Event").alias("origin"), key_of("node", "Event").alias("reached"))


@query(f"WITH RECURSIVE {STEPS}, f AS (SELECT * FROM s WHERE dst_type IN ('click', 'view')), w AS (SELECT src, dst FROM f UNION SELECT w.src, f.dst FROM w JOIN f ON f.src = w.dst) SELECT src AS origin, count(*) AS n FROM w GROUP BY 1")
def varlen_filtered_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps all of which lead to a click or view: the filter is in the closure's edges."""
    g = table_graph(spark, sf_dir)
    e = label(g, ends(g, g.e("CFG"), src=["Event"]).select("package_id", "src", "dst"), "dst", "Event", where=F.col("identifier_name").isin("click", "view"))
    found = reach(e, e.select("package_id", F.col("src").alias("origin"), F.col("src").alias("node")))
    return found.groupBy(key_of("origin", "Event").alias("origin")).agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {STEPS}, f AS (SELECT * FROM s WHERE dst_type = 'view'), w AS (SELECT event_id AS src, event_id AS dst FROM events WHERE event_type = 'signup' UNION SELECT w.src, f.dst FROM w JOIN f ON f.src = w.dst) SELECT DISTINCT w.src AS origin, s.dst AS reached FROM w JOIN s ON s.src = w.dst")
def varlen_last_hop_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a signup over views; the last step may lead anywhere."""
    g = table_graph(spark, sf_dir)
    free = ends(g, g.e("CFG"), src=["Event"]).select("package_id", "src", "dst")
    views = label(g, free, "dst", "Event", where=F.col("identifier_name") == "view")
    seeds = start(g, "origin", "Event", where=F.col("identifier_name") == "signup").withColumn("node", F.col("origin"))
    found = reach(views, seeds, min_hops=0).join(free.select("package_id", F.col("src").alias("node"), F.col("dst").alias("last")), ["package_id", "node"])
    return found.select(key_of("origin", "Event").alias("origin"), key_of("last", "Event").alias("reached")).distinct()


@query("SELECT conv_id, count(*) * (count(*) - 1) // 2 AS n_pairs FROM conversations GROUP BY 1 HAVING count(*) > 1")
def conversation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns of which one follows the other."""
    g = table_graph(spark, sf_dir)
    e = ends(g, g.e("CFG"), src=["Turn"]).select("package_id", "src", "dst")
    found = reach(e, e.select("package_id", F.col("src").alias("origin"), F.col("src").alias("node")))
    return found.groupBy(F.substring_index("package_id", "-", -1).cast("long").alias("conv_id")).agg(F.count("*").alias("n_pairs"))


@query(f"WITH RECURSIVE {CHAIN}, w AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 400000 UNION SELECT v.src FROM w JOIN v ON v.dst = w.k) SELECT k AS order_key FROM w")
def confirm_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from which a costly one is reached: booleans, so backward from the goals."""
    g = table_graph(spark, sf_dir)
    costly = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").cast("string").alias("package_id"), node("Order", F.col("o_orderkey")).alias("node"))
    return reached(version_edges(g), costly, min_hops=0, backward=True).select(key_of("node", "Order").alias("order_key"))


@query("""WITH RECURSIVE """ + CHAIN + """, r AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 9000 UNION SELECT r.c, v.dst FROM r JOIN v ON v.src = r.k)
SELECT c AS customer, count(DISTINCT l_orderkey * 1000 + l_linenumber) AS n_sinks FROM r JOIN lineitem ON l_orderkey = k WHERE l_returnflag = 'R' AND l_quantity >= 45 GROUP BY 1""")
def taint_reach_intra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rich customers and the returned bulk items that they reach over any dependencies."""
    g = table_graph(spark, sf_dir)
    seeds = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").cast("string").alias("package_id"), node("Customer", F.col("c_custkey")).alias("origin")).withColumn("node", F.col("origin"))
    found = reach(g.e("PDG").select("package_id", "src", "dst"), seeds).withColumnRenamed("node", "sink")
    sinks = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(node("LineItem", item_key()).alias("sink")).distinct()  # rows of items may share a key
    return found.join(sinks, "sink").groupBy(key_of("origin", "Customer").alias("customer")).agg(F.count("*").alias("n_sinks"))


@query("""WITH RECURSIVE """ + CHAIN + """, ok AS (SELECT v.* FROM v JOIN orders ON o_orderkey = dst WHERE o_orderstatus <> 'P'),
r AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 9000 AND o_orderpriority = '1-URGENT' UNION SELECT r.c, ok.dst FROM r JOIN ok ON ok.src = r.k)
SELECT DISTINCT l_orderkey * 1000 + l_linenumber AS item FROM r JOIN lineitem ON l_orderkey = k WHERE l_returnflag = 'R' AND l_quantity >= 45""")
def taint_reach_bottom_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned bulk items reached from urgent orders of rich customers, over versions that are not pending: passable edges first, then one closure of booleans."""
    g = table_graph(spark, sf_dir)
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").cast("string").alias("package_id"), node("Customer", F.col("c_custkey")).alias("src"))
    seeds = ends(g, g.e("PDG", "SO", "1-URGENT"), dst=["Order"]).join(rich, ["package_id", "src"], "left_semi").select("package_id", F.col("dst").alias("node"))
    versions = label(g, version_edges(g), "dst", "Order", where=F.col("identifier_name") != "P")
    passable = versions.unionByName(ends(g, g.e("PDG", "SO"), dst=["LineItem"]).select("package_id", "src", "dst"))
    found = reached(passable, seeds).withColumnRenamed("node", "sink")
    sinks = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(node("LineItem", item_key()).alias("sink"))
    return found.join(sinks, "sink", "left_semi").select(key_of("sink", "LineItem").alias("item")).distinct()


@query(f"WITH {CHAIN} SELECT l_returnflag AS flag, count(*) AS n FROM orders a JOIN v ON v.src = a.o_orderkey JOIN lineitem ON l_orderkey = v.dst WHERE a.o_orderpriority = '1-URGENT' GROUP BY 1")
def version_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c)-[:SO urgent]->(o)-[:NV]->(next)-[:SO]->(item)."""
    g = table_graph(spark, sf_dir)
    found = ends(g, g.e("PDG", "SO", "1-URGENT"), dst=["Order"]).select("package_id", F.col("src").alias("c"), F.col("dst").alias("o"))
    found = hop(g, hop(g, found, "o", "next", "PDG", "NV"), "next", "item", "PDG", "SO", keep={"flag": "identifier_name"}, types=["LineItem"])
    return found.groupBy("flag").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_partkey AS part, l_orderkey AS order_key FROM lineitem")
def parameter_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived edges: a part to the orders that an item joins it to."""
    g = table_graph(spark, sf_dir)
    found = ends(g, g.e("PDG", "SO"), ["Order"], ["LineItem"]).select("package_id", F.col("src").alias("o"), F.col("dst").alias("i"))
    found = hop(g, found, "i", "p", "PDG", "DEP", reverse=True, types=["Part"])
    return found.select(key_of("p", "Part").alias("part"), key_of("o", "Order").alias("order_key")).distinct()


@query("SELECT r_name || '/' || n_name || '/' || s_name AS path FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def call_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All walks from a region to a supplier, as a recursive query."""
    g = table_graph(spark, sf_dir)
    edges = ends(g, g.e("AST", "child"), dst=["Nation", "Supplier"]).select("package_id", "src", "dst")
    found = paths(spark, edges, start(g, "node", "Region"), 2).where("size(path) = 3")
    for i, (v, kind) in enumerate((("r", "Region"), ("n", "Nation"), ("s", "Supplier"))):
        found = label(g, found.withColumn(v, F.col("path")[i]), v, kind, keep={f"{v}_name": "identifier_name"})
    return found.select(F.concat_ws("/", "r_name", "n_name", "s_name").alias("path"))


# unions, cascades, aggregation -------------------------------------------------------------------


@query("SELECT o_custkey AS customer FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def union_branches_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table_graph(spark, sf_dir)
    urgent = ends(g, g.e("PDG", "SO", "1-URGENT"), dst=["Order"]).select(F.col("package_id").try_cast("long").alias("customer"))
    returned = ends(g, g.e("PDG", "SO", "R"), dst=["LineItem"]).select(F.col("package_id").try_cast("long").alias("customer"))
    return union(urgent, returned)


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def union_branches_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table_graph(spark, sf_dir)
    by_name = [ends(g, g.e("PDG", "SO", n), dst=["Order"]).select(key_of("dst", "Order").alias("k")) for n in ("1-URGENT", "2-HIGH")]
    return union(*by_name, ends(g, g.e("PDG", "SO", "R"), dst=["LineItem"]).select(key_of("src", "Order").alias("k")))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 0 UNION SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 UNION SELECT n_nationkey, n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION SELECT n_nationkey, n_name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal < 0")
def union_branches_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table_graph(spark, sf_dir)
    nation = start(g, "n", "Nation", keep={"name": "identifier_name"})
    below = lambda k: hop(g, start(g, "r", "Region", where=F.col("node_id") == TYPES["Region"] * UNIT + k), "r", "n", "AST", "child")
    suppliers = hop(g, nation, "n", "s", "AST", "child", types=["Supplier"])
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.lit("tree").alias("package_id"), node("Customer", F.col("c_custkey")).alias("s"))
    branches = [exists(nation, below(0), "n"), exists(nation, below(1), "n"), exists(nation, suppliers, "n"), exists(nation, exists(hop(g, nation, "n", "s", "AST", "child", types=["Customer"]), poor, "s"), "n")]
    return union(*(b.select(key_of("n", "Nation").cast("int").alias("id"), "name") for b in branches))


@query("SELECT o_orderkey AS k, CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN 'returned' WHEN max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 THEN 'accepted' ELSE 'none' END AS kind FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def cascade_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pattern that an order fits."""
    g = table_graph(spark, sf_dir)
    by_flag = [ends(g, g.e("PDG", "SO", flag), dst=["LineItem"]).select(F.col("src").alias("o"), F.lit(kind).alias("kind")).distinct() for flag, kind in (("R", "returned"), ("A", "accepted"))]
    rest = start(g, "o", "Order").select("o", F.lit("none").alias("kind"))
    return first_match([*by_flag, rest], ["o"]).select(key_of("o", "Order").alias("k"), "kind")


@query("SELECT n_name AS nation, string_agg(s_name, ',' ORDER BY s_name) AS suppliers FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def collect_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table_graph(spark, sf_dir)
    found = hop(g, start(g, "n", "Nation", keep={"nation": "identifier_name"}), "n", "s", "AST", "child", types=["Supplier"])
    found = label(g, found, "s", "Supplier", keep={"supplier": "identifier_name"})
    return found.groupBy("nation").agg(F.array_join(F.array_sort(F.collect_list("supplier")), ",").alias("suppliers"))


@query("SELECT o_custkey AS customer, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def collect_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table_graph(spark, sf_dir)
    items = ends(g, g.e("PDG", "SO"), dst=["LineItem"])
    return items.groupBy(F.col("package_id").try_cast("long").alias("customer")).agg(F.array_join(F.array_sort(F.collect_set("identifier_name")), ",").alias("flags"))


@query("SELECT c_mktsegment AS segment, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def transpose_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation to its segments, turned around."""
    g = table_graph(spark, sf_dir)
    found = hop(g, start(g, "n", "Nation", keep={"nation": "identifier_name"}), "n", "c", "AST", "child", types=["Customer"])
    segments = table(spark, sf_dir, "customer").select(node("Customer", F.col("c_custkey")).alias("c"), "c_mktsegment")
    adjacency = found.join(segments, "c").groupBy("nation").agg(F.collect_set("c_mktsegment").alias("segments"))
    turned = adjacency.select("nation", F.explode("segments").alias("segment"))
    return turned.groupBy("segment").agg(F.array_join(F.array_sort(F.collect_set("nation")), ",").alias("nations"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_discount, l_tax FROM lineitem")
def dedup_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax").distinct()


@query("WITH t AS (SELECT c_custkey, list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority IS NOT NULL)) AS l FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT c_custkey AS customer, CASE WHEN l IS NULL OR len(l) = 0 THEN 'any' WHEN len(l) = 1 THEN l[1] ELSE '{' || array_to_string(l, ',') || '}' END AS type FROM t")
def union_type_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None: any; one: itself; more: a union."""
    g = table_graph(spark, sf_dir)
    orders = ends(g, g.e("PDG", "SO"), dst=["Order"]).select(F.col("package_id").try_cast("long").alias("customer"), "identifier_name")
    own = start(g, "c", "Customer").select(key_of("c", "Customer").alias("customer"))
    return own.join(orders, "customer", "left").groupBy("customer").agg(text.union_type(F.collect_set("identifier_name")).alias("type"))


_WORDS = (("ECONOMY", "cheap"), ("STEEL", "metal"), ("BRASS", "metal"), ("PROMO", "cheap"), ("STANDARD", "plain"), ("LARGE", "big"))


@query("SELECT p_partkey AS part, CASE " + " ".join(f"WHEN contains(upper(p_type), '{w}') THEN '{k}'" for w, k in _WORDS) + " END AS class FROM part")
def config_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first class of a keyword table whose keyword a type has."""
    config = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(k).alias("class")) for w, k in _WORDS))
    fits = F.filter(config, lambda c: F.upper("p_type").contains(c["word"]))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.get(fits, F.lit(0))["class"].alias("class"))


@query("SELECT o_custkey AS customer, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1")
def single_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order for each customer, by a fixed order."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), "o_orderdate", F.col("o_orderkey").alias("first_order"))
    return single(rows, ["customer"], ["o_orderdate", "first_order"]).select("customer", "first_order")


@query("SELECT o_custkey AS customer, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders GROUP BY 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("customer")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("priority"))


@query("SELECT l_orderkey AS k, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS by_text, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS by_number FROM lineitem GROUP BY 1")
def order_by_param_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals as text and as numbers."""
    items = table(spark, sf_dir, "lineitem")
    number = F.array_sort(F.collect_list("l_linenumber"))
    return items.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(F.col("l_linenumber").cast("string"))), ",").alias("by_text"), F.array_join(F.transform(number, lambda x: x.cast("string")), ",").alias("by_number"))


# scalar functions, sources and sinks ---------------------------------------------------------------


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.json_int(F.col("props"), "$.k").alias("k"))


@query("SELECT n_nationkey, split_part(split_part('3.' || n_name || '-o1', '.', 2), '-', 1) AS name FROM nation")
def object_name_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", text.object_parameter(F.concat(F.lit("3."), "n_name", F.lit("-o1"))).alias("name"))


@query(r"SELECT doc_id, ltrim(coalesce(string_split(text, chr(10))[2], ''), ' ') AS line FROM documents")
def text_line_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second line of each document, by a join with its lines; none: empty."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.lit("documents").alias("package_id"), F.col("doc_id").alias("path"), F.col("text").alias("content"))
    wanted = docs.select(F.col("doc_id").alias("path"), F.lit(2).alias("lineno"))
    found = wanted.join(source_lines(files), ["path", "lineno"], "left")
    return found.select(F.col("path").alias("doc_id"), F.coalesce(text.left_trimmed(F.col("line")), F.lit("")).alias("line"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '<script[^>]*>')) AS n_scripts FROM pages")
def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<script[^>]*>"), F.lit(0))).cast("long").alias("n_scripts"))


@query(r"""WITH s AS (SELECT page_id, array_to_string(regexp_extract_all(html, '<script[^>]*>([^<]*(?:<[^/][^<]*|</[^s][^<]*)*)</script>', 1), chr(10)) AS code FROM pages)
SELECT page_id, len(regexp_extract_all(code, '\btrack\('))::BIGINT AS n_calls FROM s WHERE regexp_matches(code, '\btrack\(')""")
def script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of track in the graphs of the pages' inline scripts."""
    code = F.array_join(F.regexp_extract_all("html", F.lit("<script[^>]*>([^<]*(?:<[^/][^<]*|</[^s][^<]*)*)</script>"), F.lit(1)), "\n")
    files = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("package_id"), F.lit("inline.js").alias("path"), code.alias("content"))
    graph = program_graph(files, spark.createDataFrame([("track", 1)], "sink string, arg int"))
    return graph.n("PDG_CALL").where("identifier_name = 'track'").groupBy(F.col("package_id").cast("long").alias("page_id")).agg(F.count("*").alias("n_calls"))


@query(r"SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.base_name(F.col("url")).alias("base"))


@query("""SELECT 'Region' AS type, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part
UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'LineItem', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Turn', count(*) FROM conversations""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_graph(spark, sf_dir).nodes.groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH {CHAIN}, {STEPS}, i AS (SELECT l_orderkey * 1000 + l_linenumber AS k, l_partkey, l_suppkey, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
t AS (SELECT *, EXISTS (SELECT 1 FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn = c.turn + 1) AS more FROM conversations c),
r AS (SELECT 'Region' AS kind, r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 'Nation', n_nationkey, n_name FROM nation UNION ALL SELECT 'Customer', c_custkey, c_name FROM customer UNION ALL SELECT 'Supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'Part', p_partkey, p_name FROM part
UNION ALL SELECT 'Order', o_orderkey, o_orderstatus FROM orders UNION ALL SELECT 'LineItem', k, max(l_returnflag) FROM i GROUP BY k UNION ALL SELECT 'Event', event_id, event_type FROM events UNION ALL SELECT 'Turn', conv_id * 1000000 + turn, role FROM conversations
UNION ALL SELECT 'AST child', n_nationkey, '' FROM nation UNION ALL SELECT 'AST child', c_custkey, '' FROM customer UNION ALL SELECT 'AST child', s_suppkey, '' FROM supplier UNION ALL SELECT 'PDG SO', o_orderkey, o_orderpriority FROM orders UNION ALL SELECT 'PDG SO', k, l_returnflag FROM i UNION ALL SELECT 'PDG NV', dst, '' FROM v
UNION ALL SELECT 'PDG DEP', k, '' FROM i UNION ALL SELECT 'PDG DEP', k, '' FROM i UNION ALL SELECT 'CFG ', dst, '' FROM s UNION ALL SELECT 'CFG ', conv_id * 1000000 + turn + 1, '' FROM t WHERE more)
SELECT kind, count(*) AS n, sum(k % 1000003)::BIGINT AS keys, sum(length(name))::BIGINT AS letters FROM r GROUP BY 1""")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph written to interchange files and read again: numbers, keys and names of each kind of node and edge (by its end)."""
    g = table_graph(spark, sf_dir)
    typed = lambda df, schema: df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex[:12]}"
    write_graph(PropertyGraph(typed(g.nodes, NODES), typed(g.edges, EDGES)), f"{folder}/nodes", f"{folder}/rels", compression="gzip")
    back = read_graph(spark, f"{folder}/nodes", f"{folder}/rels")
    nodes = back.nodes.select(F.col("type").alias("kind"), F.col("node_id").alias("id"), "identifier_name")
    edges = back.edges.select(F.concat_ws(" ", "rel_type", F.coalesce("relation_type", F.lit(""))).alias("kind"), F.col("dst").alias("id"), "identifier_name")
    key, name = F.col("id") % UNIT % 1000003, F.length(F.coalesce("identifier_name", F.lit("")))
    return nodes.unionByName(edges).groupBy("kind").agg(F.count("*").alias("n"), F.sum(key).alias("keys"), F.sum(name).cast("long").alias("letters"))


@query("SELECT '  \"' || n_regionkey || '\" -> \"' || n_nationkey || '\" [label=\"' || n_name || '\"];' AS line FROM nation")
def dot_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as lines of a drawing."""
    g = table_graph(spark, sf_dir)
    edges = label(g, ends(g, g.e("AST", "child"), dst=["Nation"]).select("package_id", "src", "dst"), "dst", "Nation", keep={"name": "identifier_name"})
    q = F.lit('"')
    return edges.select(F.concat(F.lit('  "'), key_of("src", "Region").cast("string"), F.lit('" -> "'), key_of("dst", "Nation").cast("string"), F.lit('" [label="'), "name", q, F.lit("];")).alias("line"))


@query("WITH words(class, word, ord) AS (VALUES ('plain', 'STANDARD', 0), ('metal', 'STEEL', 1), ('metal', 'BRASS', 2), ('cheap', 'STEEL', 3), ('cheap', 'PROMO', 4)), c AS (SELECT word, arg_min(class, ord) AS class FROM words GROUP BY 1) SELECT p_partkey AS part, split_part(p_type, ' ', 1) AS first, class FROM part LEFT JOIN c ON word = split_part(p_type, ' ', 1)")
def sink_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of the first word of each part's type, as that of a sink: the first of the list that has it."""
    rows = [("plain", "STANDARD", 0), ("metal", "STEEL", 1), ("metal", "BRASS", 2), ("cheap", "STEEL", 3), ("cheap", "PROMO", 4)]
    classes = vulnerability_types(spark.createDataFrame(rows, "vuln_type string, sink string, ord int"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("first"))
    return parts.join(classes.withColumnsRenamed({"sink_name": "first", "vuln_type": "class"}), "first", "left").select("part", "first", "class")
