"""Shrinking a graph whose edges carry values, for questions whose rounds would otherwise follow its longest path.

Nodes whose removal adds no edges (on chains, in trees, between two others) are taken out, many at a time: of two
neighbours the one with the smaller hash. An edge over such a node has the joined values of the two it replaces, and of
parallel edges the best stays. A chain is gone after a number of rounds that grows with its logarithm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .closure import written

_PAIR = ["package_id", "src", "dst"]


def best_edges(step: DataFrame, best: Callable[[str], Column]) -> DataFrame:
    """One edge for each two nodes, without loops."""
    return step.where("src <> dst").groupBy(*_PAIR).agg(best("value").alias("value"))


def contracted(step: DataFrame, kept: DataFrame, join: Callable[[Column, Column], Column], best: Callable[[str], Column]) -> tuple[DataFrame, list[DataFrame]]:
    """The edges (package_id, src, dst, value) between nodes of kept (package_id, node) and those that could not be taken out; and the edges into what each round took out."""
    step, taken = written(best_edges(step, best)), []
    while True:
        ends = step.select("package_id", F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(step.select("package_id", F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
        degree = ends.groupBy("package_id", "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).where("i * o <= i + o")
        rank = F.xxhash64("package_id", "node", F.lit(len(taken))).alias("rank")
        free = written(degree.join(kept, ["package_id", "node"], "left_anti").select("package_id", "node", rank))
        one = step.join(free.withColumnsRenamed({"node": "src", "rank": "ra"}), ["package_id", "src"]).join(free.withColumnsRenamed({"node": "dst", "rank": "rb"}), ["package_id", "dst"])
        beaten = one.select("package_id", F.when(F.col("ra") > F.col("rb"), F.col("src")).otherwise(F.col("dst")).alias("node"))
        out = written(free.join(beaten, ["package_id", "node"], "left_anti").select("package_id", "node"))
        if out.isEmpty():
            return step, taken
        src, dst = out.withColumnRenamed("node", "src"), out.withColumnRenamed("node", "dst")
        into = written(step.join(dst, ["package_id", "dst"], "left_semi"))
        onward = step.join(src, ["package_id", "src"], "left_semi")
        over = into.select("package_id", "src", F.col("dst").alias("mid"), F.col("value").alias("near")).join(onward.select("package_id", F.col("src").alias("mid"), "dst", F.col("value").alias("far")), ["package_id", "mid"])
        over = over.select(*_PAIR, join(F.col("near"), F.col("far")).alias("value"))
        rest = step.join(dst, ["package_id", "dst"], "left_anti").join(src, ["package_id", "src"], "left_anti")
        step = written(best_edges(rest.select(*_PAIR, "value").unionByName(over), best))
        taken.append(into.select(*_PAIR, "value"))
