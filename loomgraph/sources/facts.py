"""Files to fact tables, and fact tables to a linked graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from loomgraph.graph import CodeGraph, number
from loomgraph.operators import link
from loomgraph.plans import scratch
from loomgraph.sources.parsers import ffi, languages

Parser = Callable[[str, str], languages.Facts]

_PLACE = "line:int"
_FIELDS = {
    "imports": f"module_path:string,imported_names:array<string>,is_glob:boolean,metadata:map<string,string>,{_PLACE},column:int",
    "definitions": "kind:string,name:string,parent:string,signature:string,is_public:boolean,doc:string,metadata:map<string,string>,start_line:int,start_column:int,end_line:int,end_column:int",
    "calls": f"caller:string,callee:string,receiver:string,call_kind:string,{_PLACE}",
    "type_refs": f"source:string,type_name:string,ref_kind:string,{_PLACE}",
}
SCHEMA = "path string, language string, " + ", ".join(f"{k} array<struct<{v}>>" for k, v in _FIELDS.items()) + ", error string, error_line int, error_column int, category string"


def spread(files: DataFrame) -> DataFrame:
    """The files by path in some parts for each core: a small table of paths may hold the work of many, which bytes do not tell."""
    spark = files.sparkSession
    return files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "path")


def parse_files(files: DataFrame, parser: Parser = languages.parse) -> DataFrame:
    """One row a file (path, language, content): its facts as lists, or the error that its text met.

    Texts that a batch has more than once are parsed once.
    """
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(SCHEMA)])
    found, maps = schema.names[2:], {name for name, fields in _FIELDS.items() if "metadata:" in fields}
    shape = pa.struct([schema.field(name) for name in found])

    def facts_of(language: str | None, content: str | None) -> dict:
        try:
            if content is None:
                raise OSError("no content")
            facts = parser(content, language)
        except SyntaxError as e:
            return {"error": str(e.msg), "error_line": e.lineno, "error_column": e.offset, "category": "syntax"} | dict.fromkeys(_FIELDS, [])
        except OSError as e:
            return {"error": str(e), "category": "io"} | dict.fromkeys(_FIELDS, [])
        except Exception as e:  # a file must not end the job: what it met is reported
            return {"error": f"{type(e).__name__}: {e}", "category": "internal"} | dict.fromkeys(_FIELDS, [])
        pairs = lambda fact: fact | {"metadata": list((fact.get("metadata") or {}).items())}
        return {name: [pairs(x) for x in facts.get(name, [])] if name in maps else facts.get(name, []) for name in _FIELDS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: dict[tuple, int] = {}
            at = [places.setdefault(text, len(places)) for text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            made = pa.array([facts_of(*text) for text in places], shape)
            if len(places) < len(at):
                made = made.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made.flatten()], schema=schema)

    return spread(files.select("path", "language", "content")).mapInArrow(run, SCHEMA)


BINDINGS = "array<struct<line:int,symbol:string,source_lang:string,target_lang:string,kind:string>>"
FACTS = f"{SCHEMA}, bindings {BINDINGS}"


def fact_rows(files: DataFrame, parser: Parser = languages.parse) -> DataFrame:
    """``parse_files`` with the foreign-function bindings of each file as a further list."""
    found = ffi.detect_all(spread(files)).groupBy("path").agg(F.collect_list(F.struct(F.col("line").cast("int").alias("line"), "symbol", "source_lang", "target_lang", "kind")).alias("bindings"))
    return parse_files(files, parser).join(found, "path", "left").withColumn("bindings", F.coalesce("bindings", F.array().cast(BINDINGS)))


@dataclass(frozen=True)
class Encoded:
    graph: CodeGraph
    parse_errors: DataFrame
    files_processed: int
    files_skipped: int

    @property
    def is_complete(self) -> bool:
        return self.files_skipped == 0


def explode(parsed: DataFrame, name: str) -> DataFrame:
    """A fact table: path, language, its fields and ``at``, the place in its file's list."""
    return parsed.select("path", "language", F.posexplode(name).alias("at", "fact")).select("path", "language", "at", "fact.*")


def encode(files: DataFrame, root: str = "root", parser: Parser = languages.parse) -> Encoded:
    """Parse (path, language, content), build nodes in the order of path and text, and link them.

    The order of nodes is that of building: repository, then for each file its directory (if new), itself, its
    definitions and imports; link passes follow, and number their edges after those of containment.
    """
    parsed = scratch.materialize(fact_rows(files, parser), "parsed")
    good = parsed.where("error IS NULL")
    nodes = scratch.materialize(node_rows(parsed, root), "numbered")
    linked = scratch.materialize(link.link_all([contained(nodes), *link_passes(nodes, good)]), "passes")  # numbering reads it thrice
    edges = number(linked, "edge_seq", ["phase", "turn", "src", "dst"])
    graph = CodeGraph(shown(nodes), scratch.materialize(edges.select("edge_seq", "src", "dst", "edge_type", "metadata"), "linked"))
    failed = parsed.where("error IS NOT NULL").select("path", "error", F.col("error_line").alias("line"), F.col("error_column").alias("column"), "category")
    return Encoded(graph, failed, good.count(), failed.count())


def node_rows(parsed: DataFrame, root: str = "root") -> DataFrame:
    """The nodes of files, in order and numbered from 0; those of bindings name their file and target in their metadata."""
    good = parsed.where("error IS NULL")
    definitions, imports, bindings = explode(good, "definitions"), explode(good, "imports"), explode(parsed, "bindings")
    location = lambda a, b, c, d: F.struct(F.col("path").alias("file"), *[F.col(x).cast("int").alias(n) if isinstance(x, str) else x.cast("int").alias(n) for x, n in zip((a, b, c, d), ("start_line", "start_column", "end_line", "end_column"), strict=True)])
    base = good.select("path", "language", F.lit(0).cast("bigint").alias("seq"))
    placed = link.file_nodes(base.withColumn("seq", F.xxhash64("path")), root).drop("seq")
    first = base.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path")).agg(F.min("path").alias("home"), F.min_by("language", "path").alias("first_language"))
    placed = placed.join(first, "path", "left").withColumn("language", F.when(F.col("category") == "directory", F.col("first_language")).otherwise(F.col("language")))
    where = F.when(F.col("category") == "file", F.col("path")).when(F.col("category") == "directory", F.col("home")).otherwise("")
    none = F.lit(None)
    loc, meta, text = none.cast("struct<file:string,start_line:int,start_column:int,end_line:int,end_column:int>"), none.cast("map<string,string>"), none.cast("string")
    structural = placed.select(where.alias("_file"), "rank", F.lit(0).alias("at"), "category", "kind", "language", "name", "path", loc.alias("location"), meta.alias("metadata"), text.alias("signature"), text.alias("documentation"), F.array().cast("array<string>").alias("imported_names"))
    defined = link.definition_nodes(definitions.withColumn("location", location("start_line", "start_column", "end_line", "end_column")).withColumn("seq", F.col("at")))
    defined = defined.select(F.col("path").alias("_file"), F.lit(3).alias("rank"), F.col("seq").alias("at"), "category", "kind", "language", "name", "path", "location", "metadata", "signature", "documentation", F.array().cast("array<string>").alias("imported_names"))
    brought = imports.select(F.col("path").alias("_file"), F.lit(4).alias("rank"), "at", F.lit("import").alias("category"), F.lit("import").alias("kind"), "language", F.col("module_path").alias("name"), "path", location("line", "column", "line", "column").alias("location"), "metadata", text.alias("signature"), text.alias("documentation"), "imported_names")
    bound = bindings.select(F.lit("\U0010ffff").alias("_file"), F.lit(5).alias("rank"), F.col("line").alias("at"), F.lit("feature").alias("category"), F.lit("ffi_binding").alias("kind"), F.col("source_lang").alias("language"), F.col("symbol").alias("name"), text.alias("path"), loc.alias("location"), F.create_map(F.lit("file"), F.col("path"), F.lit("target"), F.col("target_lang"), F.lit("kind"), F.col("kind")).alias("metadata"), text.alias("signature"), text.alias("documentation"), F.array().cast("array<string>").alias("imported_names"))
    rows = structural.unionByName(defined).unionByName(brought).unionByName(bound)
    return number(rows, "node_seq", ["_file", "rank", "at", "name"]).withColumn("node_seq", F.col("node_seq") - 1).withColumn("node_id", F.col("node_seq"))


def shown(nodes: DataFrame) -> DataFrame:
    """The graph's columns of node rows."""
    none = F.lit(None)
    text = none.cast("string")
    return nodes.withColumn("metadata", F.when(F.col("rank") != 5, F.col("metadata"))).select("node_id", "node_seq", "category", "kind", "language", "name", "path", "location", "metadata", text.alias("description"), F.array().cast("array<string>").alias("features"), text.alias("feature_path"), "signature", none.cast("struct<start_line:int,end_line:int>").alias("source_ref"), text.alias("semantic_feature"), F.lit("low").alias("node_level"), "documentation")


def parent_of(path: str) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def contained(nodes: DataFrame) -> DataFrame:
    """(src, dst, edge_type, seq): directories contain their files, and these what has their path."""
    files = nodes.where("category = 'file'").select("path", F.col("node_id").alias("src"))
    folders = nodes.where("category = 'directory'").select(F.col("path").alias("_p"), F.col("node_id").alias("src"))
    inside = files.select("path", F.col("src").alias("dst")).join(folders, parent_of("path") == F.col("_p")).select("src", "dst")
    members = nodes.where("category NOT IN ('file', 'directory', 'repository') AND path IS NOT NULL").select("path", F.col("node_id").alias("dst")).join(files, "path").select("src", "dst")
    return inside.unionByName(members).withColumn("edge_type", F.lit("contains")).withColumn("seq", F.col("dst"))


def link_passes(nodes: DataFrame, parsed: DataFrame, fresh: DataFrame | None = None, names: DataFrame | None = None) -> list[DataFrame]:
    """The edges of imports, calls, type references, implementations, bases and bindings.

    ``nodes`` are all of a graph, ``parsed`` the facts of all its files. With ``fresh`` (path) and ``names`` (name) only facts are
    linked that are of these files or name one of these names; what they are linked to may be anywhere.
    """

    def chosen(df: DataFrame, name: Column) -> DataFrame:
        if fresh is None or names is None:
            return df
        named = df.withColumn("_key", name)
        own = named.join(fresh.select("path").distinct(), "path", "left_semi")
        other = named.join(fresh.select("path").distinct(), "path", "left_anti").join(names.select(F.col("name").alias("_key")).distinct(), "_key", "left_semi")
        return own.select(*df.columns).unionByName(other.select(*df.columns))

    files = nodes.where("category = 'file'").select("path", "node_id")
    symbols = nodes.where("category NOT IN ('repository', 'directory', 'file', 'import', 'feature') AND path IS NOT NULL").select("path", "name", "node_id", "node_seq", "kind")
    types = nodes.where("category = 'type'").select("name", "path", "node_seq")
    brought = explode(parsed, "imports").select("path", "module_path", "imported_names")
    import_nodes = chosen(nodes.where("category = 'import'").select("path", F.col("name").alias("module_path"), "node_id", F.col("node_seq").alias("seq")), link.last_segment(F.col("module_path")))
    order = lambda df: df.withColumn("seq", F.xxhash64("path", "at"))
    called = link.link_calls(order(chosen(explode(parsed, "calls"), F.col("callee"))), symbols, brought, files, types)
    call_meta = F.map_filter(F.create_map(F.lit("receiver"), F.col("receiver"), F.lit("call_kind"), F.col("call_kind")), lambda k, v: v.isNotNull())
    used = link.link_type_refs(order(chosen(explode(parsed, "type_refs"), F.col("type_name"))), symbols, brought, files)
    bound = nodes.where("kind = 'ffi_binding' AND metadata IS NOT NULL").select(F.col("metadata")["file"].alias("path"), "node_id", F.col("name").alias("symbol"), F.col("language").alias("source_lang"), F.col("metadata")["target"].alias("target_lang"), F.col("metadata")["kind"].alias("kind"), F.lit(None).cast("string").alias("native_signature"))
    home = nodes.select(F.col("node_id").alias("src"), "path")

    def of_nodes(edges: DataFrame) -> DataFrame:
        """Implementations and bases of the chosen files or with ends of the chosen names."""
        if fresh is None or names is None:
            return edges
        ends = nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("_end"))
        return chosen(edges.join(home, "src", "left").join(ends, "dst"), F.col("_end")).select(*edges.columns)

    return [
        link.link_imports(import_nodes, symbols),
        called.withColumn("metadata", call_meta),
        used.withColumn("metadata", F.create_map(F.lit("ref_kind"), F.col("ref_kind"))),
        of_nodes(link.link_impls(nodes)),
        of_nodes(link.link_extends(nodes)),
        link.link_ffi(bound, files)[1],
    ]
