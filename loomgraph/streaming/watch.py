"""Following a source tree: micro-batches of changed files evolve the graph of a store.

Every batch is a patch of the store, written with the facts of its files; the manifest takes both and the batch's number by one act, so a
batch that is run again after a failure does nothing, or everything anew, and each takes effect once. The store is compacted
when its threshold says so.

Edges are linked again wherever a changed file defines or defined a name: for the facts of the changed files, and for those of any
file that name it. The graph is then, but for its numbers, that of the new tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.graph import CodeGraph
from loomgraph.operators import diff, evolve, link
from loomgraph.plans import scratch
from loomgraph.sources import facts, walk
from loomgraph.sources.store import Store, changes_between

DEBOUNCE = "2 seconds"
FILES = "path string, content string, deleted boolean"


def latest(changes: DataFrame) -> DataFrame:
    """Of several rows of one path in a batch the last to be modified."""
    return changes.groupBy("path").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "path"]), "modified").alias("v")).select("path", "v.*")


def start(store: Store, files: DataFrame, root: str = "root") -> facts.Encoded:
    """Encode files (path, language, content) and save graph and facts as the store's base."""
    made = facts.encode(files, root)
    store.save_base(made.graph, facts.fact_rows(files))
    return made


def apply_batch(store: Store, batch: DataFrame, batch_id: int) -> evolve.Summary | None:
    """Apply rows (path, content, deleted) to the store's graph; a batch that was applied before is skipped."""
    manifest = store.manifest()
    if batch_id <= manifest.batch:
        return None
    spark, graph, old = store.spark, store.load(), store.facts()
    with scratch.within(spark):
        files = graph.nodes.where("category = 'file'")
        change = F.when(F.col("deleted"), F.when(F.col("known"), "deleted")).when(F.col("known"), "modified").otherwise("added")
        changes = batch.join(files.select("path", F.lit(True).alias("known")), "path", "left").select("path", change.alias("change")).where("change IS NOT NULL")
        changes = scratch.materialize(changes, "changes")
        texts = batch.where("NOT deleted").select("path", walk.language_of(F.col("path")).alias("language"), "content").where("language IS NOT NULL")
        fresh = scratch.materialize(facts.fact_rows(texts), "facts")
        every = old.join(changes.select("path"), "path", "left_anti").unionByName(fresh).where("error IS NULL")
        names = scratch.materialize(touched(graph, changes, fresh, every), "names")

        def nodes_of(_: DataFrame) -> DataFrame:
            made = facts.node_rows(fresh)
            there = graph.nodes.where("category = 'directory'").select("path", F.lit("directory").alias("category"))
            rows = made.where("category <> 'repository'").join(there, ["path", "category"], "left_anti")
            # Bindings keep their metadata until they are linked.
            bound = made.where("rank = 5").select("node_id", F.col("metadata").alias("_bound"))
            return facts.shown(rows).join(bound, "node_id", "left").withColumn("metadata", F.coalesce("_bound", "metadata")).drop("_bound")

        def edges_of(g: CodeGraph) -> DataFrame:
            own = fresh.select("path")
            made = g.nodes.join(own, "path", "left_semi").unionByName(g.nodes.where("category IN ('directory')").join(own, "path", "left_anti"))
            passes = [facts.contained(made), *facts.link_passes(g.nodes, every, own, names)]
            return link.link_all(passes).select("src", "dst", "edge_type", "metadata")

        def stale(g: CodeGraph) -> DataFrame:
            ends = g.nodes.join(names, "name", "left_semi").select(F.col("node_id").alias("dst"))
            return g.edges.where(F.col("edge_type").isin(*LINKED)).join(ends, "dst", "left_semi").select("edge_seq")

        after, summary = evolve.process_diff(graph, changes, nodes_of, edges_of, stale, _gone_with(graph, changes))
        nodes = after.nodes.withColumn("metadata", F.when(F.col("kind") != "ffi_binding", F.col("metadata")))
        parted = changes.where("change = 'deleted'").select("path")
        log = fresh.withColumn("deleted", F.lit(False)).unionByName(parted.withColumn("deleted", F.lit(True)), allowMissingColumns=True)
        store.write_facts(log, batch_id)
        store.write_patch(changes_between(graph, CodeGraph(nodes, after.edges)), batch_id)
    if store.should_compact():
        store.compact()
    return summary


#: Types of edges that are made from facts.
LINKED = ("references", "calls", "uses_type", "implements", "extends")


def touched(graph: CodeGraph, changes: DataFrame, fresh: DataFrame, every: DataFrame) -> DataFrame:
    """(name) of everything that a changed file defines or defined, and of what is called on a type among them."""
    before = graph.nodes.where("category NOT IN ('repository', 'directory', 'file', 'import', 'feature')").join(changes, "path", "left_semi").select("name")
    names = before.unionAll(facts.explode(fresh.where("error IS NULL"), "definitions").select("name")).distinct()
    received = facts.explode(every, "calls").select(F.col("receiver").alias("name"), "callee").join(names, "name", "left_semi").select(F.col("callee").alias("name"))
    return names.unionAll(received).distinct()


def _gone_with(graph: CodeGraph, changes: DataFrame) -> DataFrame:
    """(node_id) of the bindings of files that go or are made again, and of directories without a file left."""
    gone = changes.where("change IN ('deleted', 'modified')").select("path")
    files = graph.nodes.where("category = 'file'").select("path", F.col("node_id").alias("src"))
    bound = graph.edges.where("edge_type = 'ffi_binding'").join(files.join(gone, "path", "left_semi"), "src", "left_semi").select(F.col("dst").alias("node_id"))
    stay = files.select("path").unionAll(changes.where("change = 'added'").select("path")).join(changes.where("change = 'deleted'").select("path"), "path", "left_anti")
    empty = graph.nodes.where("category = 'directory'").join(stay.select(facts.parent_of("path").alias("path")), "path", "left_anti").select("node_id")
    return bound.unionAll(empty).distinct()


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, interval: str = DEBOUNCE, available_now: bool = False) -> StreamingQuery:
    """Follow a folder of change files (JSON lines of path, content, deleted, modified)."""
    stream = spark.readStream.schema(f"{FILES}, modified bigint").json(folder)

    def each(batch: DataFrame, batch_id: int) -> None:
        apply_batch(store, latest(batch), batch_id)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, content, deleted) that leads from one tree (path, content) to another."""
    changes = diff.file_diff(diff.file_hashes(old), diff.file_hashes(new))
    return changes.join(new, "path", "left").select("path", "content", (F.col("change") == "deleted").alias("deleted"))
