"""Graph primitives over two tables. Parallel edges and self-loops are kept; nothing here deduplicates edges.

Lookups come for one key (a filter) and for all keys at once (a window or aggregate), so that a caller with many keys joins
instead of looping. "First" means the least ``node_seq`` or ``edge_seq``; adjacency lists the newest edge first.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans import scratch


@dataclass(frozen=True)
class CodeGraph:
    nodes: DataFrame
    edges: DataFrame

    # Scans and counts

    def counts(self) -> DataFrame:
        """(nodes, edges)."""
        return self.nodes.agg(F.count("*").alias("nodes")).crossJoin(self.edges.agg(F.count("*").alias("edges")))

    def node(self, node_id: int) -> DataFrame:
        return self.nodes.where(F.col("node_id") == node_id)

    def node_exists(self) -> DataFrame:
        """The ids of nodes with a name that is not empty; others count as missing."""
        return self.nodes.where("name IS NOT NULL AND name <> ''").select("node_id")

    # First matches

    def find(self, **equal: object) -> DataFrame:
        """The first node whose columns equal the values, or no row."""
        condition = F.lit(True)
        for name, value in equal.items():
            condition &= F.col(name) == value
        return self.nodes.where(condition).orderBy("node_seq").limit(1)

    def first_by(self, *keys: str) -> DataFrame:
        """(keys, node_id, matches): for every key the first node, and how many have the key; null keys have none."""
        return self.nodes.dropna(subset=list(keys)).groupBy(*keys).agg(F.min_by("node_id", "node_seq").alias("node_id"), F.count("*").alias("matches"))

    def find_by_location(self, path: str, line: int) -> DataFrame:
        """The first node of a file that begins on a line."""
        return self.find(**{"path": path, "location.start_line": line})

    def first_by_location(self) -> DataFrame:
        """(path, line, node_id, matches): for every file and line that a node begins on, the first, and how many there are."""
        return CodeGraph(self.nodes.withColumn("line", F.col("location.start_line")), self.edges).first_by("path", "line")

    def nodes_for_file(self, path: str) -> DataFrame:
        return self.nodes.where(F.col("path") == path)

    def of_level(self, level: str) -> DataFrame:
        return self.nodes.where(F.col("node_level") == level)

    def functional_centroids(self) -> DataFrame:
        return self.nodes.where((F.col("node_level") == "high") & (F.col("kind") == "functional_centroid"))

    # Adjacency

    def successors(self, edge_type: str | None = None) -> DataFrame:
        """(node_id, other_id, edge_seq, edge_type) of outgoing edges, once for each parallel edge."""
        return self._adjacent("src", "dst", edge_type)

    def predecessors(self, edge_type: str | None = None) -> DataFrame:
        return self._adjacent("dst", "src", edge_type)

    def _adjacent(self, here: str, there: str, edge_type: str | None) -> DataFrame:
        edges = self.edges if edge_type is None else self.edges.where(F.col("edge_type") == edge_type)
        return edges.select(F.col(here).alias("node_id"), F.col(there).alias("other_id"), "edge_seq", "edge_type")

    def children(self) -> DataFrame:
        return self.successors("contains")

    def centroid_members(self) -> DataFrame:
        """(node_id, other_id, ...): the members of each centroid, which the node_id is."""
        return self.predecessors("belongs_to_feature")

    def edges_involving(self) -> DataFrame:
        """(node_id, edge_seq, other_id, edge_type, direction); a self-loop once, as outgoing."""
        out = self.successors().withColumn("direction", F.lit("outgoing"))
        into = self.predecessors().where("node_id <> other_id").withColumn("direction", F.lit("incoming"))
        return out.unionAll(into)

    def edge_between(self) -> DataFrame:
        """(src, dst, edge_seq, edge_type, parallel): of each connected pair the newest edge."""
        return self.edges.groupBy("src", "dst").agg(F.max("edge_seq").alias("edge_seq"), F.max_by("edge_type", "edge_seq").alias("edge_type"), F.count("*").alias("parallel"))

    # Changes: each gives a new graph

    def add_nodes(self, rows: DataFrame) -> CodeGraph:
        """Rows without ids, in the order of their ``node_seq``, get the ids that follow the greatest."""
        last = self.nodes.agg(F.coalesce(F.max("node_id"), F.lit(-1)).alias("_id"), F.coalesce(F.max("node_seq"), F.lit(-1)).alias("_seq"))
        numbered = number(rows.drop("node_id"), "_turn", "node_seq").crossJoin(F.broadcast(last))  # one row
        fresh = numbered.withColumn("node_id", F.col("_id") + F.col("_turn")).withColumn("node_seq", F.col("_seq") + F.col("_turn"))
        return CodeGraph(self.nodes.unionByName(fresh.select(*self.nodes.columns), allowMissingColumns=True), self.edges)

    def add_edges(self, rows: DataFrame) -> CodeGraph:
        """Edges whose ends exist are added; others are not."""
        return CodeGraph(self.nodes, self.edges.unionByName(with_both_ends(rows, self.nodes), allowMissingColumns=True))

    def remove_nodes(self, ids: DataFrame) -> CodeGraph:
        """Without the nodes of (node_id) and all their edges."""
        return CodeGraph(self.nodes.join(ids, "node_id", "left_anti"), self.without_edges_of(ids))

    def remove_file_nodes(self, paths: DataFrame) -> CodeGraph:
        """Without all nodes of the files (path)."""
        return self.remove_nodes(self.nodes.join(paths, "path", "left_semi").select("node_id"))

    def without_edges_of(self, ids: DataFrame) -> DataFrame:
        """The edges that touch none of (node_id)."""
        by = lambda end: ids.select(F.col("node_id").alias(end)).distinct()
        return self.edges.join(by("src"), "src", "left_anti").join(by("dst"), "dst", "left_anti").select(*self.edges.columns)

    def retain_edges(self, condition: Column) -> CodeGraph:
        return CodeGraph(self.nodes, self.edges.where(condition))

    def remove_edge_between(self, src: int, dst: int) -> CodeGraph:
        """Without the newest edge from src to dst; its parallel edges stay."""
        newest = self.edges.where((F.col("src") == src) & (F.col("dst") == dst)).agg(F.max("edge_seq").alias("edge_seq"))
        return CodeGraph(self.nodes, self.edges.join(newest, "edge_seq", "left_anti").select(*self.edges.columns))

    def update_semantics(self, changes: DataFrame) -> CodeGraph:
        """(node_id, features, description, feature_path) replace what the nodes have; nulls change nothing."""
        names = ("features", "description", "feature_path")
        new = changes.select("node_id", *[F.col(c).alias(f"_{c}") for c in names])
        joined = self.nodes.join(new, "node_id", "left")
        for c in names:
            joined = joined.withColumn(c, F.coalesce(f"_{c}", c))
        return CodeGraph(joined.select(*self.nodes.columns), self.edges)

    def cleanup_orphans(self) -> CodeGraph:
        """Without edges whose end is missing or has no name."""
        return CodeGraph(self.nodes, with_both_ends(self.edges, self.node_exists()))

    # Centroids

    def add_centroid(self, name: str, feature: str) -> CodeGraph:
        spark = self.nodes.sparkSession
        row = spark.createDataFrame([(0, "module", "functional_centroid", "", name, feature, "high")], "node_seq bigint, category string, kind string, language string, name string, semantic_feature string, node_level string")
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.nodes.schema if f.name not in row.columns]
        return self.add_nodes(row.select("*", *missing))

    def ground_centroids(self) -> DataFrame:
        """(node_id, path, semantic_feature) of each centroid whose members have a path or a feature.

        The path is the members' common ancestor unless the centroid has one; features are joined by "; " in order of membership.
        """
        members = self.centroid_members().alias("e").join(self.nodes.alias("m"), F.col("m.node_id") == F.col("e.other_id"))
        listed = F.sort_array(F.collect_list(F.struct("e.edge_seq", "m.path", "m.semantic_feature")))
        grouped = members.groupBy(F.col("e.node_id").alias("node_id")).agg(listed.alias("all"))
        paths = F.filter(F.transform("all", lambda x: x["path"]), lambda p: p.isNotNull())
        features = F.filter(F.transform("all", lambda x: x["semantic_feature"]), lambda p: p.isNotNull())
        some = grouped.select("node_id", paths.alias("paths"), features.alias("features")).where((F.size("paths") > 0) | (F.size("features") > 0))
        own = self.nodes.select("node_id", F.col("path").alias("own"))
        return some.join(own, "node_id").select("node_id", F.coalesce("own", common_ancestor(F.col("paths"))).alias("path"), F.array_join("features", "; ").alias("semantic_feature"))


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are among the nodes."""
    by = lambda end: nodes.select(F.col("node_id").alias(end))
    return edges.join(by("src"), "src", "left_semi").join(by("dst"), "dst", "left_semi").select(*edges.columns)


def common_ancestor(paths: Column) -> Column:
    """Of no paths "", of one its directory, of more the components that all begin with."""
    parts = F.transform(paths, lambda p: F.split(p, "/"))
    shared = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), parts[0], _shared_prefix)
    parent = F.slice(parts[0], 1, F.greatest(F.size(parts[0]) - 1, F.lit(0)))
    return F.when(F.size(paths) == 0, "").when(F.size(paths) == 1, F.array_join(parent, "/")).otherwise(F.array_join(shared, "/"))


def _shared_prefix(a: Column, b: Column) -> Column:
    # The place of the first difference, counted from 1; arrays are padded with null by arrays_zip.
    differ = F.array_position(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"])), True)
    return F.when(differ == 0, a).otherwise(F.slice(a, 1, (differ - 1).cast("int")))


def number(rows: DataFrame, name: str, order: str | Iterable[str]) -> DataFrame:
    """Add 1, 2, 3 ... in the given order, without bringing all rows into one task.

    Rows are sorted by range and written with their place in it; each range is shifted by the sizes of those before it. Sizes are
    counted in what was written: ranges that are made twice, from a sample or by adaptive coalescing, need not be the same.
    """
    order = [order] if isinstance(order, str) else list(order)
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_mono"))
    placed = scratch.materialize(spread.withColumn("_part", F.shiftright("_mono", 33)).withColumn("_in", F.col("_mono").bitwiseAND((1 << 33) - 1)).drop("_mono"), "placed")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_part", before.alias("_shift"))  # a row for each partition
    return placed.join(F.broadcast(shifts), "_part").withColumn(name, F.col("_shift") + F.col("_in") + 1).drop("_part", "_in", "_shift")
