"""The calls that a tool server offers, each a DataFrame over the graph of one store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import fetch, report, search
from loomgraph.operators.search import SERVICE_CATEGORIES
from loomgraph.schema import EDGE_TYPES
from loomgraph.sources import facts, walk
from loomgraph.sources.store import Store


class Service:
    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store = spark, store
        self._graph = store.load() if store.exists("CURRENT") else None

    @property
    def graph(self):
        if self._graph is None:
            raise LookupError("nothing is encoded yet: call encode_repo")
        return self._graph

    def encode_repo(self, root: str) -> DataFrame:
        """Encode a tree, save it as the store's base, and report on it."""
        made = facts.encode(walk.walk(self.spark, root), root)
        self.store.save_base(made.graph)
        self._graph = self.store.load()
        return report.validation(self._graph).withColumn("files_processed", F.lit(made.files_processed)).withColumn("files_skipped", F.lit(made.files_skipped))

    def get_graph_summary(self) -> DataFrame:
        return report.summary(self.graph).crossJoin(report.import_resolution(self.graph))

    def search_nodes(self, query: str, kind: str | None = None, category: str | None = None, limit: int = 50) -> DataFrame:
        return search.by_substring(self.graph.nodes, query, kind, category, limit)

    def get_node_details(self, node_id: int) -> DataFrame:
        """The node with all its edges at both ends; no row if there is no such node."""
        edges = fetch.edge_infos(self.graph).where(F.col("node_id") == node_id)
        return self.graph.node(node_id).join(edges, "node_id", "left")

    def get_edges(self, source: int | None = None, target: int | None = None, edge_type: str | None = None, limit: int = 100) -> DataFrame:
        return fetch.get_edges(self.graph, source, target, edge_type, limit)

    def get_skeleton(self) -> DataFrame:
        return fetch.skeleton(self.graph).orderBy("path")

    def get_features(self, file_path: str | None = None, limit: int = 100) -> DataFrame:
        return fetch.with_features(self.graph, file_path, limit)

    def get_components(self, limit: int = 100) -> DataFrame:
        return fetch.components(self.graph, limit)


def ignored_filters(category: str | None = None, edge_type: str | None = None) -> list[str]:
    """The filters that a caller named but that do not exist, and so filter nothing."""
    out = []
    if category and category.lower() not in SERVICE_CATEGORIES:
        out.append(f"category {category}")
    if edge_type and edge_type.lower() not in EDGE_TYPES:
        out.append(f"edge type {edge_type}")
    return out
