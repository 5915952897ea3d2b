"""What a node is connected with, and the listings that a service offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import CodeGraph
from loomgraph.schema import EDGE_TYPES


def edge_infos(graph: CodeGraph) -> DataFrame:
    """(node_id, direction, edge_type, edge_seq, other_id, other_name, other_category) of all edges at both ends."""
    other = graph.nodes.select(F.col("node_id").alias("other_id"), F.col("name").alias("other_name"), F.col("category").alias("other_category"))
    both = graph.successors().withColumn("direction", F.lit("outgoing")).unionAll(graph.predecessors().withColumn("direction", F.lit("incoming")))
    return both.join(other, "other_id").select("node_id", "direction", "edge_type", "edge_seq", "other_id", "other_name", "other_category")


def parents(graph: CodeGraph) -> DataFrame:
    """(node_id, parent_id, edge_seq): a predecessor counts if the newest edge between the two contains; it counts once for each parallel edge."""
    newest = graph.edge_between().where("edge_type = 'contains'").select("src", "dst")
    return graph.edges.join(newest, ["src", "dst"]).select(F.col("dst").alias("node_id"), F.col("src").alias("parent_id"), "edge_seq")


def functional_centroid(graph: CodeGraph) -> DataFrame:
    """(node_id, centroid_id): the target of the newest edge of belonging."""
    belongs = graph.edges.where("edge_type = 'belongs_to_feature'")
    return belongs.groupBy(F.col("src").alias("node_id")).agg(F.max_by("dst", "edge_seq").alias("centroid_id"))


def details(graph: CodeGraph) -> DataFrame:
    """One row a node: (node_id, incoming, outgoing, parents, children, members, centroid_id), lists of ids in order."""
    listed = lambda df, key, value, name: df.groupBy(F.col(key).alias("node_id")).agg(F.sort_array(F.collect_list(value)).alias(name))
    parts = [
        listed(graph.edges, "dst", "src", "incoming"),
        listed(graph.edges, "src", "dst", "outgoing"),
        listed(parents(graph), "node_id", "parent_id", "parents"),
        listed(graph.children(), "node_id", "other_id", "children"),
        listed(graph.centroid_members(), "node_id", "other_id", "members"),
    ]
    out = graph.nodes.select("node_id")
    for part in parts:
        name = part.columns[1]
        out = out.join(part, "node_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))
    return out.join(functional_centroid(graph), "node_id", "left")


def fetch(graph: CodeGraph, **equal: object) -> DataFrame:
    """The details of the first node whose columns equal the values; a missing node is an error."""
    found = graph.find(**equal).first()
    if found is None:
        raise KeyError(f"no node with {equal}")
    return details(graph).where(F.col("node_id") == found.node_id)


def get_edges(graph: CodeGraph, source: int | None = None, target: int | None = None, edge_type: str | None = None, limit: int | None = 100) -> DataFrame:
    """The first edges that meet all conditions; an unknown type is no condition."""
    edges = graph.edges
    if source is not None:
        edges = edges.where(F.col("src") == source)
    if target is not None:
        edges = edges.where(F.col("dst") == target)
    if edge_type is not None and edge_type.lower() in EDGE_TYPES:
        edges = edges.where(F.col("edge_type") == edge_type.lower())
    return edges if limit is None else edges.orderBy("edge_seq").limit(limit)


def skeleton(graph: CodeGraph) -> DataFrame:
    """(path, file_id, child_count, children) of every file, the children's names in order of their nodes."""
    files = graph.nodes.where("category = 'file'").select(F.col("node_id").alias("file_id"), "path")
    inside = graph.children().join(graph.nodes.select(F.col("node_id").alias("other_id"), "name", "node_seq"), "other_id")
    inside = inside.groupBy(F.col("node_id").alias("file_id")).agg(F.count("*").alias("child_count"), F.transform(F.sort_array(F.collect_list(F.struct("node_seq", "name"))), lambda x: x["name"]).alias("children"))
    return files.join(inside, "file_id", "left").select("path", "file_id", F.coalesce("child_count", F.lit(0)).cast("bigint").alias("child_count"), F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def with_features(graph: CodeGraph, path_part: str | None = None, limit: int | None = 100) -> DataFrame:
    """The first nodes that have features or a description, in files whose path has the text in it."""
    found = graph.nodes.where("size(features) > 0 OR description <> ''")
    if path_part is not None:
        found = found.where(F.contains("path", F.lit(path_part)))
    return found if limit is None else found.orderBy("node_seq").limit(limit)


def components(graph: CodeGraph, limit: int | None = 100) -> DataFrame:
    found = graph.nodes.where("category = 'component'")
    return found if limit is None else found.orderBy("node_seq").limit(limit)
