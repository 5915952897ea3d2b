"""The versioned store: base tables, an ordered change log, and their replay.

A store is a folder. ``base/<n>/nodes`` and ``base/<n>/edges`` are full tables, ``patches/<n>`` the changes since base n, partitioned by
``seq``; ``CURRENT`` names n and is replaced last, by one rename, so readers see one whole version or the other. It also holds the last batch that was
applied. A patch is rows (op, path, node, edge): deletions come before removals, and these before additions. ``facts/<n>`` has the facts that files were
last parsed to, by batch, from which edges are linked again.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.graph import CodeGraph, with_both_ends
from loomgraph.schema import EDGES, NODES
from loomgraph.sources.facts import FACTS

VERSION = 1
_COLUMNS = [c.strip().split(" ", 1) for c in NODES.split(", ")]
PATCH_TYPES = {"path": "string", "node": f"struct<{','.join(f'{name}:{kind}' for name, kind in _COLUMNS)}>", "edge": "struct<edge_seq:bigint,src:bigint,dst:bigint,edge_type:string,metadata:map<string,string>>"}
PATCH = "op string, " + ", ".join(f"{name} {kind}" for name, kind in PATCH_TYPES.items())
OPS = ("delete_file", "remove_node", "remove_edge", "add_node", "add_edge", "set_hash")


@dataclass(frozen=True)
class Threshold:
    """Compact at so many patches, or once they have this share of the base's bytes."""

    patches: int = 10
    ratio: float = 0.5


@dataclass(frozen=True)
class Manifest:
    version: int = VERSION
    base: int = 0
    patches: tuple[int, ...] = ()
    #: The last micro-batch that was applied; -1 before the first.
    batch: int = -1


class Store:
    def __init__(self, spark: SparkSession, folder: str, threshold: Threshold = Threshold()):
        self.spark, self.folder, self.threshold = spark, folder.rstrip("/"), threshold

    # Files

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._fs(name)
        return fs.exists(path)

    def size(self, name: str) -> int:
        """Bytes of a folder; 0 if it is not there."""
        fs, path = self._fs(name)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def _write_manifest(self, manifest: Manifest) -> None:
        fs, new = self._fs("CURRENT.new")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        stream.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        overwrite = gateway.new_array(rename, 1)
        overwrite[0] = rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(new, self._fs("CURRENT")[1], overwrite)

    def manifest(self) -> Manifest:
        if not self.exists("CURRENT"):
            raise FileNotFoundError(f"no store in {self.folder}")
        raw = json.loads(self.spark.read.text(f"{self.folder}/CURRENT", wholetext=True).first().value)
        if raw["version"] != VERSION:
            raise ValueError(f"store version {raw['version']} is not {VERSION}")
        return Manifest(raw["version"], raw["base"], tuple(raw["patches"]), raw.get("batch", -1))

    # Base

    def save_base(self, graph: CodeGraph, facts: DataFrame | None = None) -> Manifest:
        """Write a new base, with the facts of its files if they are given, and point to it; the patches of the old one end with it."""
        old = self.manifest() if self.exists("CURRENT") else Manifest()
        base = old.base + 1
        for name, df in (("nodes", graph.nodes), ("edges", graph.edges)):
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/base/{base}/{name}")
        if facts is not None:
            self.write_facts(facts, old.batch, base)
        manifest = Manifest(base=base, batch=old.batch)
        self._write_manifest(manifest)
        return manifest

    def load_base(self) -> CodeGraph:
        base = self.manifest().base
        return CodeGraph(*(self.spark.read.parquet(f"{self.folder}/base/{base}/{name}") for name in ("nodes", "edges")))

    # Facts

    def write_facts(self, facts: DataFrame, batch: int, base: int | None = None) -> None:
        """The facts of the files of a batch; written again they replace themselves, and they count once the batch does."""
        full = facts if "deleted" in facts.columns else facts.withColumn("deleted", F.lit(False))
        full.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/facts/{self.manifest().base if base is None else base}/batch={batch}")

    def facts(self) -> DataFrame:
        """The facts of every file of the store, as last parsed; none if the base was saved without any."""
        manifest = self.manifest()
        folder = f"{self.folder}/facts/{manifest.base}"
        kept = f"{FACTS}, deleted boolean"
        if not self.exists(f"facts/{manifest.base}"):
            return self.spark.createDataFrame([], kept).drop("deleted")
        every = self.spark.read.schema(f"{kept}, batch bigint").option("basePath", folder).parquet(folder).where(F.col("batch") <= manifest.batch)
        last = every.groupBy("path").agg(F.max("batch").alias("batch"))
        return every.join(last, ["path", "batch"], "left_semi").where("NOT deleted").drop("batch", "deleted")

    # Patches

    def next_seq(self) -> int:
        return max(self.manifest().patches, default=0) + 1

    def write_patch(self, changes: DataFrame, batch: int | None = None) -> int:
        """Append changes (op, path, node, edge) as the next patch; with ``batch`` that is applied by the same act."""
        manifest, seq = self.manifest(), self.next_seq()
        changes.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/patches/{manifest.base}/seq={seq}")
        self._write_manifest(Manifest(base=manifest.base, patches=(*manifest.patches, seq), batch=manifest.batch if batch is None else batch))
        return seq

    def patches(self) -> DataFrame:
        """(seq, op, path, node, edge) of the listed patches, up to the first that is missing."""
        manifest = self.manifest()
        there = []
        for seq in manifest.patches:
            if not self.exists(f"patches/{manifest.base}/seq={seq}"):
                break
            there.append(seq)
        folder = f"{self.folder}/patches/{manifest.base}"
        if not there:
            return self.spark.createDataFrame([], f"seq int, {PATCH}")
        return self.spark.read.schema(PATCH).option("basePath", folder).parquet(*[f"{folder}/seq={seq}" for seq in there]).select("seq", "op", "path", "node", "edge")

    def load(self) -> CodeGraph:
        return replay(self.load_base(), self.patches())

    # Compaction

    def should_compact(self) -> bool:
        manifest = self.manifest()
        n, base = len(manifest.patches), self.size(f"base/{manifest.base}")
        return n > 0 and (n >= self.threshold.patches or self.size(f"patches/{manifest.base}") >= self.threshold.ratio * base)

    def compact(self) -> Manifest:
        """A new base of base and patches; the old ones are deleted once it is current."""
        old = self.manifest()
        new = self.save_base(self.load(), self.facts() if self.exists(f"facts/{old.base}") else None)
        for name in (f"base/{old.base}", f"patches/{old.base}", f"facts/{old.base}"):
            fs, path = self._fs(name)
            fs.delete(path, True)
        return new


def changes_between(old: CodeGraph, new: CodeGraph) -> DataFrame:
    """The patch (op, path, node, edge) that leads from one graph to another of the same ids."""
    columns = [name for name, _ in _COLUMNS if name in new.nodes.columns]
    none = lambda field: F.lit(None).cast(PATCH_TYPES[field]).alias(field)
    full = lambda graph: graph.nodes.select(*columns, F.xxhash64(F.to_json(F.struct(*columns))).alias("_mark"))
    own = F.struct(*[F.col(c) if c in columns else F.lit(None).alias(c) for c, _ in _COLUMNS]).cast(PATCH_TYPES["node"]).alias("node")
    before, after = full(old), full(new)
    same = before.select("node_id", "_mark")
    put = after.join(same, ["node_id", "_mark"], "left_anti").select(F.lit("add_node").alias("op"), none("path"), own, none("edge"))
    gone = before.join(after.select("node_id"), "node_id", "left_anti").select(F.lit("remove_node").alias("op"), none("path"), own, none("edge"))
    key = ["src", "dst", "edge_type"]
    # Numbers of removed edges are given again, so an edge is the same only in all it has.
    marked = lambda graph, old: graph.edges.select("edge_seq", *key, "metadata", F.xxhash64("edge_seq", *key, F.to_json("metadata")).alias("_mark"), F.lit(old).alias("_old"))
    # Both graphs are sorted once, by ends and type, for all that is asked of them.
    same_edge, same_key = Window.partitionBy(*key, "_mark"), Window.partitionBy(*key)
    sides = marked(old, True).unionAll(marked(new, False))
    sides = sides.withColumn("_lost", F.min("_old").over(same_edge)).withColumn("_new", ~F.max("_old").over(same_edge))
    sides = sides.withColumn("_cut", F.max("_lost").over(same_key)).withColumn("_turn", F.row_number().over(same_key.orderBy("_mark")))
    # A removal takes all edges of its ends and type, so those that stay are put again.
    ops = [
        F.when(F.col("_cut") & (F.col("_turn") == 1), F.struct(F.lit("remove_edge").alias("op"), F.struct(F.lit(None).cast("bigint").alias("edge_seq"), *key, F.lit(None).cast("map<string,string>").alias("metadata")).alias("edge"))),
        F.when(~F.col("_old") & (F.col("_cut") | F.col("_new")), F.struct(F.lit("add_edge").alias("op"), F.struct("edge_seq", *key, "metadata").alias("edge"))),
    ]
    edges = sides.where(F.col("_cut") | F.col("_new")).select(F.explode(F.filter(F.array(*ops), lambda x: x.isNotNull())).alias("x"))
    return put.unionAll(gone).unionAll(edges.select("x.op", none("path"), none("node"), F.col("x.edge").cast(PATCH_TYPES["edge"]).alias("edge")))


def replay(base: CodeGraph, patches: DataFrame) -> CodeGraph:
    """Apply all patches at once: what a key's last addition and last deletion are decides.

    A patch's deletions come before its additions, so a node that one patch deletes and adds again stays.
    """
    added = patches.where("op = 'add_node'").select("seq", F.col("node.node_id").alias("node_id"), "node")
    newest = added.groupBy("node_id").agg(F.max_by("node", "seq").alias("node"), F.max("seq").alias("seq"))
    old = base.nodes.join(newest.select("node_id"), "node_id", "left_anti").select(*base.nodes.columns, F.lit(0).alias("seq"))
    every = old.unionByName(newest.select(*[F.col(f"node.{c}").alias(c) for c in base.nodes.columns], "seq"))
    removed = patches.where("op = 'remove_node'").groupBy(F.col("node.node_id").alias("node_id")).agg(F.max("seq").alias("_gone"))
    deleted = patches.where("op = 'delete_file'").groupBy("path").agg(F.max("seq").alias("_cut"))
    kept = every.join(removed, "node_id", "left").join(deleted, "path", "left").where("greatest(coalesce(_gone, 0), coalesce(_cut, 0)) <= seq").select(*base.nodes.columns)

    key = ["src", "dst", "edge_type"]
    dropped = patches.where("op = 'remove_edge'").groupBy(*[F.col(f"edge.{c}").alias(c) for c in key]).agg(F.max("seq").alias("_gone"))
    plus = patches.where("op = 'add_edge'").select(*[F.col(f"edge.{c}").alias(c) for c in base.edges.columns], "seq")
    edges = base.edges.withColumn("seq", F.lit(0)).unionByName(plus)
    edges = edges.join(dropped, key, "left").where("coalesce(_gone, 0) <= seq").select(*base.edges.columns)
    return CodeGraph(kept, with_both_ends(edges, kept))


def file_index(graph: CodeGraph) -> DataFrame:
    """(path, node_ids) of every path, ids in order."""
    return graph.nodes.where("path IS NOT NULL").groupBy("path").agg(F.sort_array(F.collect_list("node_id")).alias("node_ids"))


def to_json(graph: CodeGraph) -> DataFrame:
    """(kind, line): every node and edge as a JSON object; ids are named, empty lists and maps left out."""
    name = lambda c: F.concat(F.lit("node_"), F.col(c).cast("string"))
    filled = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    own = [filled(c) if c in ("features", "metadata") else F.col(c) for c in graph.nodes.columns if c not in ("node_id", "node_seq")]
    nodes = graph.nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(name("node_id").alias("id"), *own)).alias("line"))
    edge = [name("src").alias("source"), name("dst").alias("target"), F.col("edge_type").alias("type"), *([filled("metadata")] if "metadata" in graph.edges.columns else [])]
    return nodes.unionAll(graph.edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edge)).alias("line")))


def from_json(spark: SparkSession, nodes_path: str, edges_path: str) -> CodeGraph:
    """Node and edge tables from JSON lines; edges with an unknown end are left out."""
    nodes = spark.read.schema(NODES).json(nodes_path)
    return CodeGraph(nodes, with_both_ends(spark.read.schema(EDGES).json(edges_path), nodes))


#: Fill colours of node categories in drawings.
COLOURS = {"repository": "#d9d2e9", "directory": "#cfe2f3", "file": "#d0e0e3", "module": "#d9ead3", "type": "#fff2cc", "function": "#fce5cd", "import": "#eeeeee", "constant": "#ead1dc", "variable": "#f4cccc", "feature": "#c9daf8", "component": "#b6d7a8", "functional_centroid": "#a2c4c9"}


def to_dot(graph: CodeGraph, imports: bool = False, colours: bool = True) -> DataFrame:
    """(part, ordinal, line): lines of a DOT drawing, clusters by directory of their path; import edges only on demand."""
    styles = {"contains": "dotted", "calls": "solid", "imports": "dashed", "extends": "bold", "implements": "bold"}
    style = F.coalesce(F.create_map(*[F.lit(x) for pair in styles.items() for x in pair])[F.col("edge_type")], F.lit("solid"))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '(["\\\\])', r"\\$1"), F.lit('"'))
    folder = F.regexp_extract(F.coalesce("path", F.lit("")), r"^(.*)/[^/]*$", 1)
    colour = F.coalesce(F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])[F.col("category")], F.lit("#ffffff"))
    filled = F.concat(F.lit(', style=filled, fillcolor="'), colour, F.lit('"')) if colours else F.lit("")
    member = F.concat(F.lit("n"), F.col("node_id").cast("string"), F.lit(" [label="), quoted(F.col("name")), filled, F.lit("];"))
    grouped = graph.nodes.groupBy(folder.alias("folder")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", member.alias("m")))), lambda x: x["m"]), " ").alias("members"))
    clusters = grouped.select(F.lit(1).alias("part"), F.xxhash64("folder").alias("ordinal"), F.concat(F.lit("subgraph "), quoted(F.concat(F.lit("cluster_"), F.col("folder"))), F.lit(" { "), F.col("members"), F.lit(" }")).alias("line"))
    shown = graph.edges if imports else graph.edges.where("edge_type <> 'imports'")
    arrows = shown.select(F.lit(2).alias("part"), F.col("edge_seq").alias("ordinal"), F.format_string("n%d -> n%d [style=%s];", "src", "dst", style).alias("line"))
    frame = graph.nodes.sparkSession.createDataFrame([(0, 0, "digraph code {"), (3, 0, "}")], "part int, ordinal bigint, line string")
    return frame.unionAll(clusters).unionAll(arrows)


def diagnostics(failures: DataFrame) -> DataFrame:
    """(line) of (path, line, column, error) as compilers write them."""
    place = F.concat_ws(":", "path", F.col("line").cast("string"), F.col("column").cast("string"))
    return failures.select(F.concat(place, F.lit(": error: "), F.col("error")).alias("line"))
