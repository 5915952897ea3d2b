"""Counts and rates of a graph, and who depends on whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import CodeGraph
from loomgraph.schema import edge_view

#: A rate below this, with more than so many imports, is warned of.
LOW_RATE, MANY_IMPORTS = 0.5, 10
REVERSED = ("calls", "uses_type", "references", "extends", "implements")


def category_counts(graph: CodeGraph) -> DataFrame:
    return graph.nodes.groupBy("category").agg(F.count("*").alias("n"))


def edge_type_counts(graph: CodeGraph) -> DataFrame:
    return graph.edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def edge_view_counts(graph: CodeGraph) -> DataFrame:
    return graph.edges.groupBy(edge_view(F.col("edge_type")).alias("edge_view")).agg(F.count("*").alias("n"))


def languages(graph: CodeGraph) -> DataFrame:
    return graph.nodes.where("language <> ''").select("language").distinct()


def import_resolution(graph: CodeGraph) -> DataFrame:
    """(imports, resolved, rate): edges, not nodes, count as resolved, so the rate may exceed 1; 1 without imports."""
    imports = graph.nodes.where("category = 'import'").select(F.col("node_id").alias("src"))
    resolved = graph.edges.where("edge_type IN ('references', 'imports')").join(imports, "src", "left_semi").agg(F.count("*").alias("resolved"))
    counted = imports.agg(F.count("*").alias("imports")).crossJoin(resolved)
    return counted.withColumn("rate", F.when(F.col("imports") > 0, F.col("resolved") / F.col("imports")).otherwise(1.0))


def validation(graph: CodeGraph) -> DataFrame:
    """One row: totals, the import rate, edges of three types, and a warning or null."""
    of = lambda t: F.count_if(F.col("edge_type") == t)
    edges = graph.edges.agg(F.count("*").alias("total_edges"), of("calls").alias("calls"), of("implements").alias("implements"), of("ffi_binding").alias("ffi_bindings"))
    nodes = graph.nodes.agg(F.count("*").alias("total_nodes"))
    low = (F.col("rate") < LOW_RATE) & (F.col("imports") > MANY_IMPORTS)
    text = F.format_string("low import resolution: %d of %d", "resolved", "imports")
    return nodes.crossJoin(edges).crossJoin(import_resolution(graph)).withColumn("warning", F.when(low, text))


def summary(graph: CodeGraph) -> DataFrame:
    """One row: node and edge counts, and the languages in order."""
    named = languages(graph).agg(F.sort_array(F.collect_set("language")).alias("languages"))
    return graph.counts().crossJoin(named)


def reverse_dependencies(graph: CodeGraph) -> DataFrame:
    """(node_id, dependents): the sources of each node's incoming dependencies, in order; every node has a row."""
    sources = graph.edges.where(F.col("edge_type").isin(*REVERSED)).groupBy(F.col("dst").alias("node_id")).agg(F.sort_array(F.collect_list("src")).alias("dependents"))
    return graph.nodes.select("node_id").join(sources, "node_id", "left").withColumn("dependents", F.coalesce("dependents", F.array().cast("array<bigint>")))


def dependents_of(graph: CodeGraph, node_id: int) -> DataFrame:
    """The row of one node; only its own edges are read into it."""
    return reverse_dependencies(CodeGraph(graph.node(node_id), graph.edges.where(F.col("dst") == node_id)))
