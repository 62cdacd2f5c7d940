"""Results that are kept up to date: tables in a shared folder, of which each batch of changes rewrites only the packages that it touches.

``folder/<table>/batch=<n>`` has the rows of the packages that batch n touched, ``folder/packages/batch=<n>`` names them, and
``folder/committed/batch=<n>``, one file, is written when both are whole. What is stored now are, for each package, the rows
of the last committed batch that touched it. A batch that is run again reads only batches before it and overwrites its own
rows, so nothing is there twice and the result is the same.

A closure's touched packages of up to ``SMALL`` rows are closed anew from their edges, many to a task; in larger ones only what
a changed edge can change is.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.closure import PAIRS, SMALL, reach, written

EDGES = "package_id string, src long, dst long"


def committed(spark: SparkSession, folder: str, before: int | None = None) -> list[int]:
    """The batches that are whole; with before, those with a smaller number."""
    try:
        found = spark.read.schema("batch long").parquet(f"{folder}/committed").distinct().collect()
    except (AnalysisException, Py4JJavaError) as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return sorted(r["batch"] for r in found if before is None or r["batch"] < before)


def stored(spark: SparkSession, folder: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of a table as they are now, or were before a batch."""
    batches = committed(spark, folder, before)
    if not batches:
        return spark.createDataFrame([], schema)
    touched = spark.read.schema("package_id string, batch long").parquet(f"{folder}/packages").where(F.col("batch").isin(batches))
    last = touched.groupBy("package_id").agg(F.max("batch").alias("batch"))
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/{name}").where(F.col("batch").isin(batches))
    return rows.join(last, ["package_id", "batch"], "left_semi").drop("batch")


def commit(folder: str, batch: int, packages: DataFrame, tables: dict[str, DataFrame]) -> None:
    """Stores the rows of a batch; tables have all rows, after it, of the packages (package_id) that it touches."""
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    for name, rows in tables.items():
        put(rows, name)
    put(packages.select("package_id").where("package_id is not null").distinct(), "packages")
    put(packages.sparkSession.range(1).coalesce(1), "committed")


def _applied(edges: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The changes that change something, and the edges after them."""
    key = ["package_id", "src", "dst"]
    changes = changes.where("package_id is not null and src is not null and dst is not null").groupBy(*key).agg(F.max(F.coalesce("withdrawn", F.lit(False))).alias("withdrawn"))
    there = edges.select(*key).distinct().withColumn("there", F.lit(True))
    changes = written(changes.join(there, key, "left").where(F.col("there").isNotNull() == F.col("withdrawn")).drop("there"))
    return changes, written(edges.select(*key).distinct().join(changes.select(*key), key, "left_anti").unionByName(changes.where("not withdrawn").select(*key)))


def updated(edges: DataFrame, closure: DataFrame, changes: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Edges and closure (package_id, src, dst; one edge or more) after changes (package_id, src, dst, withdrawn) to edges.

    Only what a changed edge can change is deleted and derived anew: the rows of the nodes that lead to its start. Their ways
    are walked over each other's edges; at a node whose rows stand, the walk ends and its rows are taken over. An edge
    that the changes bring and withdraw is withdrawn; one that is there already, or is withdrawn without being there, changes
    nothing. Rows with nulls are left out.
    """
    key = ["package_id", "src", "dst"]
    changes, after = _applied(edges, changes)
    start = changes.select("package_id", F.col("src").alias("node")).distinct()
    before = closure.select("package_id", F.col("dst").alias("node"), "src").join(start, ["package_id", "node"], "left_semi").select("package_id", F.col("src").alias("node"))
    stale = written(start.unionByName(before).distinct())
    as_ = lambda c: stale.withColumnRenamed("node", c)
    fresh = closure.join(as_("src"), ["package_id", "src"], "left_anti").select(*key)
    walked = reach(after.join(as_("src"), ["package_id", "src"], "left_semi"), stale.select("package_id", F.col("node").alias("origin"), "node"), small=small)
    walked = written(walked.select("package_id", F.col("origin").alias("src"), F.col("node").alias("dst")))
    ends = walked.join(as_("dst"), ["package_id", "dst"], "left_anti").withColumnRenamed("dst", "end")
    over = ends.join(fresh.withColumnRenamed("src", "end"), ["package_id", "end"]).select(*key)
    return after, fresh.unionByName(walked.unionByName(over).distinct())


def change_closure(spark: SparkSession, folder: str, batch: int, changes: DataFrame, small: int = SMALL) -> None:
    """Applies changes (package_id, src, dst, withdrawn) to the edges and closure stored in folder; a batch that is committed already is not run again."""
    if batch in committed(spark, folder):
        return
    changes = written(changes.select("package_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "withdrawn"))
    touched = changes.select("package_id").where("package_id is not null").distinct()
    before, closure = (stored(spark, folder, name, EDGES, batch) for name in ("edges", "closure"))
    before = written(before.join(touched, "package_id", "left_semi"))
    _, edges = _applied(before, changes)
    size = edges.groupBy("package_id").agg(F.count("*").alias("e"), F.countDistinct("src").alias("s"))
    big = written(size.where((F.col("e") + F.col("s") > small) | (F.col("e") * F.col("s") > PAIRS)).select("package_id"))
    # all rows of a touched package are written anew, so in a task they are derived anew from its edges: the closure before is neither read nor shuffled
    few = edges.join(big, "package_id", "left_anti")
    found = reach(few, few.select("package_id", F.col("src").alias("origin"), F.col("src").alias("node")).distinct(), small=small)
    found = found.select("package_id", F.col("origin").alias("src"), F.col("node").alias("dst"))
    if not big.isEmpty():
        found = found.unionByName(updated(*(x.join(big, "package_id", "left_semi") for x in (before, closure, changes)), small)[1])
    commit(folder, batch, touched, {"edges": edges, "closure": found})


def closure_of_changes(spark: SparkSession, changes: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Watches a Parquet folder of changes (package_id, src, dst, withdrawn) and keeps the closure in folder up to date, a micro-batch after the other."""
    rows = spark.readStream.schema(f"{EDGES}, withdrawn boolean").parquet(changes)
    return rows.writeStream.foreachBatch(lambda df, number: change_closure(df.sparkSession, folder, number, df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_detections(folder: str, batch: int, packages: DataFrame, found: DataFrame) -> None:
    """The detections of the packages (package_id) of a batch take the place of those stored for them; a package without any has none left."""
    commit(folder, batch, packages, {"detections": found.distinct()})
