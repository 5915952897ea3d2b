"""Breadth-first exploration by frontier joins.

A round joins the frontier with the edges, drops nodes seen before and keeps of each new node the edge that discovered it
first: by the order in which the nodes before were discovered, then outgoing before incoming edges, then newer before older ones. The edges that
may be followed are written once, and rounds as they come, merged now and then, so plans stay short, no round reads all
rounds before it one by one, and a lost executor costs one round.
A node that fails the node filter is neither emitted nor expanded, but counts as seen; a start that fails it gives nothing.
With a depth limit the last round still records tree edges, so edges reach one level deeper than nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import CodeGraph, number
from loomgraph.plans import scratch
from loomgraph.schema import edge_view

DEPENDENCIES = ("calls", "imports", "depends_on")
FOUND_BY = "struct<here:bigint,edge_seq:bigint,edge_type:string,from_turn:bigint>"
#: Rounds that are read one by one before they are merged.
MERGED = 6


@dataclass(frozen=True)
class Filter:
    """What to explore; None does not filter."""

    categories: Sequence[str] | None = None
    level: str | None = None
    edge_types: Sequence[str] | None = None
    view: str | None = None
    max_depth: int | None = None
    limit: int | None = None

    def node(self) -> Column:
        ok = F.lit(True)
        if self.categories is not None:
            ok &= F.col("category").isin(*self.categories)
        if self.level is not None:
            ok &= F.col("node_level") == self.level
        return ok

    def edge(self) -> Column:
        ok = F.lit(True)
        if self.view is not None:
            ok &= edge_view(F.col("edge_type")) == self.view
        if self.edge_types is not None:
            ok &= F.col("edge_type").isin(*self.edge_types)
        return ok


@dataclass(frozen=True)
class Exploration:
    """``nodes``: (start, node_id, depth); ``edges``: (start, src, dst, edge_seq, edge_type, depth), as traversed; depth counts seen nodes that were not emitted, too."""

    nodes: DataFrame
    edges: DataFrame
    depth_reached: int


def explore(graph: CodeGraph, starts: DataFrame, direction: str = "outgoing", filter_: Filter = Filter()) -> Exploration:
    """Explore from every row of (start) at once; starts do not see each other's visits.

    ``limit`` keeps the first nodes of a start in order of discovery, at least one, and the edges found from all of them but the
    last, which is not expanded; a start that has as many goes no further.
    """
    spark = graph.edges.sparkSession
    with scratch.within(spark) as kept:
        edges = graph.edges.where(filter_.edge())
        out = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"), "edge_seq", "edge_type", F.lit(0).alias("side"))
        into = edges.select(F.col("dst").alias("here"), F.col("src").alias("there"), "edge_seq", "edge_type", F.lit(1).alias("side"))
        hops = scratch.materialize({"outgoing": out, "incoming": into, "both": out.unionAll(into)}[direction], "hops")
        passing = scratch.materialize(graph.nodes.where(filter_.node()).select("node_id"), "passing")
        most = None if filter_.limit is None else max(1, filter_.limit)

        first = starts.select("start", F.col("start").alias("node_id")).distinct().join(passing, "node_id", "left_semi")
        first = first.select("start", "node_id", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("turn"), F.lit(True).alias("emitted"), F.lit(None).cast(FOUND_BY).alias("e"))
        frontier = scratch.materialize(first, "start")
        rounds = [frontier]
        depth, reached = 0, 0
        while (filter_.max_depth is None or depth <= filter_.max_depth) and not frontier.isEmpty():
            reached = depth
            seen = _union(rounds)
            open_ = frontier.where("emitted")
            if most is not None:
                # Of the frontier itself some may come before the last.
                enough = seen.where(F.col("emitted") & (F.col("depth") < depth)).groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") >= most)
                open_ = open_.join(enough, "start", "left_anti")
            step = open_.select("start", "node_id", F.col("turn").alias("from_turn")).join(hops, F.col("node_id") == F.col("here"))
            fresh = step.select("start", "here", F.col("there").alias("node_id"), "edge_seq", "edge_type", "side", "from_turn").join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti")
            order = F.struct("from_turn", "side", (-F.col("edge_seq")).alias("newest"))
            best = fresh.groupBy("start", "node_id").agg(F.min(F.struct(order.alias("o"), "here", "edge_seq", "edge_type")).alias("m"))
            depth += 1
            found = best.select("start", "node_id", F.col("m.o.from_turn").alias("from_turn"), F.col("m.o.side").alias("side"), F.col("m.o.newest").alias("newest"), "m")
            # Only the order of nodes that are expanded, or counted against the limit, is needed.
            if most is not None or filter_.max_depth is None or depth <= filter_.max_depth:
                found = number(scratch.materialize(found, "found"), "turn", ["start", "from_turn", "side", "newest"])
            else:
                found = found.withColumn("turn", F.lit(0).cast("bigint"))
            found = found.join(passing.withColumn("emitted", F.lit(True)), "node_id", "left")
            e = F.struct(F.col("m.here").alias("here"), F.col("m.edge_seq").alias("edge_seq"), F.col("m.edge_type").alias("edge_type"), "from_turn").cast(FOUND_BY).alias("e")
            frontier = scratch.materialize(found.select("start", "node_id", F.lit(depth).alias("depth"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("emitted", F.lit(False)).alias("emitted"), e), "round")
            rounds.append(frontier)
            if len(rounds) > MERGED:
                rounds = [scratch.materialize(_union(rounds), "rounds")]
        every = scratch.materialize(_union(rounds), "explored")
        kept.append(every)
    shown = every.where("emitted")
    if filter_.max_depth is not None:
        shown = shown.where(F.col("depth") <= filter_.max_depth)
    found = every.where("e IS NOT NULL")
    if most is not None:
        shown = shown.withColumn("_turn", F.row_number().over(Window.partitionBy("start").orderBy("depth", "turn"))).where(F.col("_turn") <= most)
        last = shown.where(F.col("_turn") == most).select("start", F.struct("depth", "turn").alias("_last"))
        found = found.join(last, "start", "left").where(F.col("_last").isNull() | (F.struct((F.col("depth") - 1).alias("depth"), F.col("e.from_turn").alias("turn")) < F.col("_last")))
    tree = found.select("start", F.col("e.here").alias("src"), F.col("node_id").alias("dst"), F.col("e.edge_seq").alias("edge_seq"), F.col("e.edge_type").alias("edge_type"), "depth")
    return Exploration(shown.select("start", "node_id", "depth"), tree, reached)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


def dependencies(graph: CodeGraph, starts: DataFrame, max_depth: int | None = None) -> Exploration:
    return explore(graph, starts, "outgoing", Filter(view="dependency", edge_types=DEPENDENCIES, max_depth=max_depth))


def dependents(graph: CodeGraph, starts: DataFrame, max_depth: int | None = None) -> Exploration:
    return explore(graph, starts, "incoming", Filter(view="dependency", edge_types=DEPENDENCIES, max_depth=max_depth))


def containment(graph: CodeGraph, starts: DataFrame, direction: str = "outgoing") -> Exploration:
    return explore(graph, starts, direction, Filter(edge_types=("contains",)))


def functional_area(graph: CodeGraph, starts: DataFrame) -> DataFrame:
    """(start, node_id) of all members of the centroids that a start belongs to, each once."""
    belongs = graph.edges.where("edge_type = 'belongs_to_feature'").select("src", "dst")
    own = starts.join(belongs, F.col("start") == F.col("src")).select("start", "dst").distinct()
    return own.join(belongs, "dst").select("start", F.col("src").alias("node_id")).distinct()
