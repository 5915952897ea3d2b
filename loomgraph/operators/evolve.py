"""Keeping a graph up to date: what a diff removes, adds and makes stale.

Differences to plain re-encoding that matter: nodes of unchanged files keep their ids, and edges between changed and
unchanged files are linked again for the names that the changed files define or use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import CodeGraph, number
from loomgraph.plans import scratch


def deleted_files(graph: CodeGraph, paths: DataFrame) -> CodeGraph:
    """Without the nodes of the files (path) and their edges; dependents lose features and description, which may be stale."""
    gone = graph.nodes.join(paths, "path", "left_semi").select("node_id")
    stale = graph.edges.join(gone.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node_id")).distinct().withColumn("_stale", F.lit(True))
    marked = graph.nodes.join(stale, "node_id", "left")
    fresh = F.col("_stale").isNull()
    nodes = marked.withColumn("features", F.when(fresh, F.col("features")).otherwise(F.array().cast("array<string>"))).withColumn("description", F.when(fresh, F.col("description"))).select(*graph.nodes.columns)
    return CodeGraph(nodes, graph.edges).remove_nodes(gone).cleanup_orphans()


def invalidate_centroids(graph: CodeGraph, changed: DataFrame) -> CodeGraph:
    """High-level sources of edges into changed nodes lose their feature."""
    into = graph.edges.join(changed.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("node_id")).distinct().withColumn("_stale", F.lit(True))
    stale = F.col("_stale").isNotNull() & (F.col("node_level") == "high")
    nodes = graph.nodes.join(into, "node_id", "left").withColumn("semantic_feature", F.when(~stale, F.col("semantic_feature")))
    return CodeGraph(nodes.select(*graph.nodes.columns), graph.edges)


def invalidate_feature_edges(graph: CodeGraph, changed: DataFrame) -> CodeGraph:
    """Without the edges by which changed nodes belong to high-level nodes."""
    high = graph.nodes.where("node_level = 'high'").select(F.col("node_id").alias("dst"))
    stale = graph.edges.where("edge_type = 'belongs_to_feature'").join(changed.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi").join(high, "dst", "left_semi").select("edge_seq")
    return CodeGraph(graph.nodes, graph.edges.join(stale, "edge_seq", "left_anti").select(*graph.edges.columns))


def recompute_centroids(graph: CodeGraph) -> DataFrame:
    """(node_id, semantic_feature) of high-level nodes without one: the features of connected low-level nodes, joined by "; ".

    Neighbours count once, in order of node; without any feature it is "unknown".
    """
    empty = graph.nodes.where("node_level = 'high' AND semantic_feature IS NULL").select("node_id")
    low = graph.nodes.where("node_level = 'low' AND semantic_feature IS NOT NULL").select(F.col("node_id").alias("other_id"), "node_seq", "semantic_feature")
    around = graph.successors().unionAll(graph.predecessors()).select("node_id", "other_id").distinct()
    found = empty.join(around, "node_id").join(low, "other_id").groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("node_seq", "semantic_feature"))).alias("_all"))
    text = F.array_join(F.transform("_all", lambda x: x["semantic_feature"]), "; ")
    return empty.join(found, "node_id", "left").select("node_id", F.coalesce(text, F.lit("unknown")).alias("semantic_feature"))


def best_centroids(graph: CodeGraph, changed: DataFrame) -> DataFrame:
    """(node_id, centroid_id, score) for changed low-level nodes with a feature.

    A centroid scores as many words as its feature has, if any of them is part of the node's feature as text; the most
    words win, the first among equals. A word has no white space, so it is part of one token of the feature: the substrings of
    each distinct token, of the lengths that words have, are joined with the distinct words by equality.
    """
    centroids = graph.nodes.where("node_level = 'high' AND semantic_feature IS NOT NULL").select(F.col("node_id").alias("centroid_id"), F.col("node_seq").alias("_order"), F.filter(F.split(F.lower("semantic_feature"), r"(?U)\s+"), lambda w: w != "").alias("_words"))
    words = centroids.select("centroid_id", "_order", F.size("_words").alias("score"), F.explode(F.array_distinct("_words")).alias("_word"))
    features = graph.nodes.join(changed.select("node_id").distinct(), "node_id", "left_semi").where("node_level = 'low' AND semantic_feature IS NOT NULL").select("node_id", F.lower("semantic_feature").alias("_feature"))
    tokens = features.select("_feature").distinct().select("_feature", F.explode(F.array_distinct(F.filter(F.split("_feature", r"(?U)\s+"), lambda w: w != ""))).alias("_token"))
    # One row: a number for each length that a word has.
    lengths = words.agg(F.array_sort(F.collect_set(F.length("_word"))).alias("_lengths"))
    cut = F.flatten(F.transform(F.filter("_lengths", lambda n: n <= F.length("_token")), lambda n: F.transform(F.sequence(F.lit(1), F.length("_token") - n + 1), lambda i: F.substring(F.col("_token"), i, n))))
    parts = tokens.select("_token").distinct().crossJoin(F.broadcast(lengths)).select("_token", F.explode(F.array_distinct(cut)).alias("_word"))
    # Of the centroids that share a word only the best can win, and so of the words of a token.
    best_of_word = words.groupBy("_word").agg(F.max(F.struct("score", -F.col("_order"), "centroid_id")).alias("_best"))
    best_of_token = parts.join(best_of_word, "_word").groupBy("_token").agg(F.max("_best").alias("_best"))
    best_of_feature = tokens.join(best_of_token, "_token").groupBy("_feature").agg(F.max("_best").alias("_best"))
    return features.join(best_of_feature, "_feature").select("node_id", F.col("_best.centroid_id").alias("centroid_id"), F.col("_best.score").alias("score"))


def relink_features(graph: CodeGraph, changed: DataFrame) -> DataFrame:
    """(src, dst, edge_type) of the edges to add: to the best centroid, unless some edge joins the two already."""
    best = best_centroids(graph, changed).select(F.col("node_id").alias("src"), F.col("centroid_id").alias("dst"))
    return best.join(graph.edges.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("edge_type", F.lit("belongs_to_feature"))


@dataclass(frozen=True)
class Summary:
    files_added: int = 0
    files_deleted: int = 0
    files_modified: int = 0
    nodes_created: int = 0
    nodes_removed: int = 0
    edges_removed: int = 0
    edges_linked: int = 0
    feature_edges_relinked: int = 0


def process_diff(
    graph: CodeGraph,
    changes: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    link: Callable[[CodeGraph], DataFrame] | None = None,
    stale: Callable[[CodeGraph], DataFrame] | None = None,
    also_gone: DataFrame | None = None,
) -> tuple[CodeGraph, Summary]:
    """Apply (path, change): delete, add again what was added or modified, then repair edges and centroids.

    ``encode`` gives the nodes of files (path), numbered by ``node_seq``; ``stale`` the edges (edge_seq) that are to be linked anew,
    and ``link`` the edges (src, dst, edge_type, and metadata if any) to link; ``also_gone`` are further nodes (node_id) that
    go with the files. Each phase is written to the shared folder.
    """
    spark = graph.nodes.sparkSession
    with scratch.within(spark) as result:

        def settle(g: CodeGraph) -> CodeGraph:
            return CodeGraph(scratch.materialize(g.nodes, "nodes"), scratch.materialize(g.edges, "edges"))

        gone = changes.where("change IN ('deleted', 'modified')").select("path")
        fresh = changes.where("change IN ('added', 'modified')").select("path")
        n_nodes, n_edges = graph.nodes.count(), graph.edges.count()
        left = deleted_files(graph, gone)
        kept = settle(left if also_gone is None else left.remove_nodes(also_gone))
        removed = n_nodes - kept.nodes.count()
        # Numbering reads its rows thrice.
        grown = settle(kept.add_nodes(scratch.materialize(encode(fresh), "made")))
        changed = grown.nodes.join(kept.nodes.select("node_id"), "node_id", "left_anti").select("node_id")
        repaired = invalidate_centroids(invalidate_feature_edges(grown, changed), changed)
        if stale:
            repaired = CodeGraph(repaired.nodes, repaired.edges.join(stale(grown), "edge_seq", "left_anti").select(*grown.edges.columns))
        repaired = settle(repaired)
        cut = n_edges - repaired.edges.count()

        def add(g: CodeGraph, rows: DataFrame) -> tuple[CodeGraph, int]:
            rows = scratch.materialize(rows.join(g.edges.select("src", "dst", "edge_type"), ["src", "dst", "edge_type"], "left_anti"), "rows")
            last = g.edges.agg(F.coalesce(F.max("edge_seq"), F.lit(-1)).alias("_last"))
            seq = number(rows, "_turn", ["edge_type", "src", "dst"]).crossJoin(F.broadcast(last)).withColumn("edge_seq", F.col("_last") + F.col("_turn"))  # one row
            missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in g.edges.schema if f.name not in ("edge_seq", *rows.columns)]
            out = settle(g.add_edges(seq.select("*", *missing).select(*g.edges.columns)))
            return out, out.edges.count() - g.edges.count()

        linked, n_linked = add(repaired, link(repaired)) if link else (repaired, 0)
        related, n_related = add(linked, relink_features(linked, changed))
        result += [related.nodes, related.edges]
        by = {r.change: r.n for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}  # three rows at most
        return related, Summary(by.get("added", 0), by.get("deleted", 0), by.get("modified", 0), changed.count(), removed, cut, n_linked, n_related)
