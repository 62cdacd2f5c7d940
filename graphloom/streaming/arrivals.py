"""Detections over graph tables that arrive as files: each micro-batch of packages is analysed as a corpus of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import PropertyGraph
from ..plans.packages import analyse


def detect_arrivals(spark: SparkSession, nodes: str, edges: str, config: dict[str, DataFrame], out: str, checkpoint: str, query: str = "bottom_up") -> StreamingQuery:
    """Watches a Parquet folder of nodes; a package's edges must be in the folder of edges before its nodes appear.

    A micro-batch holds whole packages if each package's nodes are one file. Its detections go to out/batch=<n>,
    overwritten if the batch is run again, so each is there once.
    """
    schema = spark.read.parquet(nodes).schema

    def batch(rows: DataFrame, number: int) -> None:
        packages = rows.select("package_id").distinct()
        own = spark.read.parquet(edges).join(packages, "package_id", "left_semi")
        analyse(PropertyGraph(rows, own), config, query=query).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(nodes).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
