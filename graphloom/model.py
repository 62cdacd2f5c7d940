"""The property graph: a node table and an edge table, every row with the package it belongs to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.closure import PAIRS, SMALL, checkpointed

POSITION = "struct<line:int,column:int>"
LOCATION = f"struct<start:{POSITION},end:{POSITION},fname:string>"
NODES = f"package_id string, node_id bigint, type string, sub_type string, function_context bigint, identifier_name string, raw string, location {LOCATION}, code string"
EDGES = "package_id string, edge_id bigint, src bigint, dst bigint, rel_type string, relation_type string, identifier_name string, argument_index int, param_index int, is_this boolean, stmt_index int, element_index int, expression_index int, method_index int, source_obj_name string, is_prop boolean"


@dataclass
class PropertyGraph:
    """A labelled multigraph. Node ids are unique in a package; parallel edges are told apart by edge_id."""

    nodes: DataFrame
    edges: DataFrame
    made: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def n(self, *types: str) -> DataFrame:
        """Nodes of some types (labels), or all."""
        return self.nodes.where(F.col("type").isin(*types)) if types else self.nodes

    def e(self, rel: str, relation: str | None = None, name: str | None = None) -> DataFrame:
        """Edges by rel_type and, where given, relation_type and identifier_name."""
        found = self.edges.where(F.col("rel_type") == rel)
        if relation is not None:
            found = found.where(F.col("relation_type") == relation)
        return found if name is None else found.where(F.col("identifier_name") == name)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several rules derive from the graph, written when the first asks for it."""
        if name not in self.made:
            found = make()
            # columns of their own: the planner cannot tell those of a checkpoint from the graph's in a join of both
            self.made[name] = checkpointed(found.select(*(F.col(c).alias(c) for c in found.columns)))
        return self.made[name]

    @cached_property
    def few(self) -> bool:
        """Whether each package's edges, once more for those derived from them, can be closed whole from all its nodes; counted once for all walks."""
        rows = self.edges.select("package_id", F.lit(1).alias("e"), F.lit(0).alias("n")).unionByName(self.nodes.select("package_id", F.lit(0).alias("e"), F.lit(1).alias("n")))
        size = rows.groupBy("package_id").agg((2 * F.sum("e")).alias("e"), F.sum("n").alias("n"))
        return size.where((2 * F.col("e") + F.col("n") > SMALL) | (F.col("e") * (F.col("e") + F.col("n")) > PAIRS)).isEmpty()

    def counts(self) -> DataFrame:
        """package_id, n_nodes, n_edges."""
        n = self.nodes.groupBy("package_id").agg(F.count("*").alias("n_nodes"))
        e = self.edges.groupBy("package_id").agg(F.count("*").alias("n_edges"))
        return n.join(e, "package_id", "full").select("package_id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
