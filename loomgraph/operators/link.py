"""From facts to a linked graph: node building, symbol indexes and the link passes, as joins.

Facts (definitions, imports, calls, type_refs, ffi_bindings) carry ``path`` and an order column ``seq``. The symbol
side of each join has one row a key, so that no pass multiplies its facts, and no pass drops repeated ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.schema import category_of_kind
from loomgraph.sources.parsers.builtins import is_common_method


def last_segment(name: Column) -> Column:
    """What follows the last ``::``."""
    return F.element_at(F.split(name, "::"), -1)


# Symbol indexes


def qualified_index(definitions: DataFrame) -> DataFrame:
    """(path, name, node_id): of several definitions in one file the last."""
    return definitions.groupBy("path", "name").agg(F.max_by("node_id", "node_seq").alias("node_id"))


def bare_index(definitions: DataFrame) -> DataFrame:
    """(name, node_id, candidates): the first definition of the name in any file, and how many there are."""
    return definitions.groupBy("name").agg(F.min_by("node_id", "node_seq").alias("node_id"), F.count("*").alias("candidates"))


def first_in_file(definitions: DataFrame) -> DataFrame:
    """(path, name, node_id): of several definitions in one file the first."""
    return definitions.groupBy("path", "name").agg(F.min_by("node_id", "node_seq").alias("node_id"))


def imported_names(imports: DataFrame) -> DataFrame:
    """(path, name) of everything that a file's imports bring in: last segments and listed names."""
    named = F.array_append(F.coalesce("imported_names", F.array().cast("array<string>")), last_segment(F.col("module_path")))
    return imports.select("path", F.explode(named).alias("name")).distinct()


# Nodes


def file_nodes(files: DataFrame, root: str) -> DataFrame:
    """Repository, directory and file rows (order, category, kind, language, name, path).

    A directory is made once, with the language of its first file; a file at the top has none.
    """
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    placed = files.select("path", "language", "seq", parent.alias("parent"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    repo = files.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("rank"), F.lit("repository").alias("category"), F.lit("unknown").alias("language"), F.lit(root).alias("name"), F.lit(root).alias("path"))
    dirs = placed.where("parent <> ''").groupBy("parent").agg(F.min("seq").alias("seq"), F.min_by("language", "seq").alias("language"))
    dirs = dirs.select("seq", F.lit(1).alias("rank"), F.lit("directory").alias("category"), "language", base(F.col("parent")).alias("name"), F.col("parent").alias("path"))
    own = placed.select("seq", F.lit(2).alias("rank"), F.lit("file").alias("category"), "language", base(F.col("path")).alias("name"), "path")
    return repo.unionByName(dirs).unionByName(own).withColumn("kind", F.col("category"))


def definition_nodes(definitions: DataFrame) -> DataFrame:
    """Node rows of definitions; signature and documentation are never null."""
    return definitions.select(
        "seq",
        category_of_kind(F.col("kind")).alias("category"),
        "kind",
        "language",
        "name",
        "path",
        "location",
        "metadata",
        F.coalesce("signature", F.lit("")).alias("signature"),
        F.coalesce("doc", F.lit("")).alias("documentation"),
    )


def import_nodes(imports: DataFrame) -> DataFrame:
    return imports.select("seq", F.lit("import").alias("category"), F.lit("import").alias("kind"), "language", F.col("module_path").alias("name"), "path", "location")


# Link passes; each gives the columns of its facts and ``src``, ``dst``, ``edge_type``


def link_imports(imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """References from import nodes (node_id, module_path) to the first definition of their last segment."""
    target = bare_index(definitions).select(F.col("name").alias("_name"), F.col("node_id").alias("dst"))
    joined = imports.join(target, last_segment(F.col("module_path")) == F.col("_name"))
    return joined.drop("_name").withColumn("src", F.col("node_id")).withColumn("edge_type", F.lit("references"))


def resolve(facts: DataFrame, name: str, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """Add ``dst`` and ``how``: the definition in the same file, else the first of an imported name, else the only one there is."""
    same = qualified_index(definitions).select(F.col("path").alias("_p"), F.col("name").alias("_n"), F.col("node_id").alias("_same"))
    bare = bare_index(definitions).select(F.col("name").alias("_bn"), F.col("node_id").alias("_bare"), F.col("candidates").alias("_many"))
    names = imported_names(imports).select(F.col("path").alias("_ip"), F.col("name").alias("_in"))
    joined = (
        facts.join(same, (F.col("path") == F.col("_p")) & (F.col(name) == F.col("_n")), "left")
        .join(names, (F.col("path") == F.col("_ip")) & (F.col(name) == F.col("_in")), "left")
        .join(bare, F.col(name) == F.col("_bn"), "left")
    )
    imported = F.when(F.col("_in").isNotNull(), F.col("_bare"))
    unique = F.when(F.col("_many") == 1, F.col("_bare"))
    how = F.when(F.col("_same").isNotNull(), "same_file").when(imported.isNotNull(), "import").when(unique.isNotNull(), "unique").otherwise("unresolved")
    return joined.withColumn("how", how).withColumn("dst", F.coalesce("_same", imported, unique)).drop("_p", "_n", "_same", "_ip", "_in", "_bn", "_bare", "_many")


def link_calls(calls: DataFrame, definitions: DataFrame, imports: DataFrame, files: DataFrame, types: DataFrame | None = None, stop_list: bool = True) -> DataFrame:
    """Edges from a call's file to what it calls; ``how`` tells by which rule.

    Calls of stop-listed names are left out. A receiver that is the name of a type node with a path leads to that
    file: the last definition of the name in it; if there is none, and for all other calls, the rules of ``resolve``
    hold. ``types`` has (name, path, node_seq); ``files`` has (path, node_id). Unresolved calls give no edge.
    """
    if stop_list:
        calls = calls.where(~is_common_method(F.col("callee")))
    resolved = resolve(calls, "callee", definitions, imports)
    if types is not None and "receiver" in calls.columns:
        homes = types.where("path IS NOT NULL").groupBy(F.col("name").alias("_type")).agg(F.min_by("path", "node_seq").alias("_home"))
        inside = qualified_index(definitions).select(F.col("path").alias("_hp"), F.col("name").alias("_hn"), F.col("node_id").alias("_there"))
        joined = resolved.join(homes, F.nullif("receiver", F.lit("")) == F.col("_type"), "left").join(inside, (F.col("_home") == F.col("_hp")) & (F.col("callee") == F.col("_hn")), "left")
        how = F.when(F.col("_there").isNotNull(), "receiver").otherwise(F.col("how"))
        resolved = joined.withColumn("how", how).withColumn("dst", F.coalesce("_there", "dst")).drop("_type", "_home", "_hp", "_hn", "_there")
    return _from_files(resolved, files, "calls")


def link_type_refs(type_refs: DataFrame, definitions: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges from a reference's file to the type it names, by the rules of ``resolve``."""
    return _from_files(resolve(type_refs, "type_name", definitions, imports), files, "uses_type")


def _from_files(resolved: DataFrame, files: DataFrame, edge_type: str) -> DataFrame:
    sources = files.select(F.col("path").alias("_fp"), F.col("node_id").alias("src"))
    return resolved.where("dst IS NOT NULL").join(sources, F.col("path") == F.col("_fp")).drop("_fp").withColumn("edge_type", F.lit(edge_type))


def _last_by_name(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.col("name").alias("_name")).agg(F.max_by("node_id", "node_seq").alias("dst"))


def link_impls(nodes: DataFrame) -> DataFrame:
    """(src, dst, edge_type) from implementations to the trait that their metadata names; of one name the last."""
    impls = nodes.where("kind = 'impl_trait'").select(F.col("node_id").alias("src"), F.get_json_object(F.concat(F.lit('{"v":'), F.col("metadata")["trait"], F.lit("}")), "$.v").alias("_trait"))
    return impls.join(_last_by_name(nodes.where("kind = 'trait'")), F.col("_trait") == F.col("_name")).select("src", "dst", F.lit("implements").alias("edge_type"))


def link_extends(nodes: DataFrame) -> DataFrame:
    """(src, dst, edge_type) from a definition to each of its bases that is a type; of one name the last."""
    bases = nodes.select(F.col("node_id").alias("src"), F.explode(F.from_json(F.col("metadata")["bases"], "array<string>")).alias("_base"))
    return bases.join(_last_by_name(nodes.where("category = 'type'")), F.col("_base") == F.col("_name")).select("src", "dst", F.lit("extends").alias("edge_type"))


def ffi_metadata(bindings: DataFrame) -> Column:
    """Edge metadata of a foreign-function binding; the kind is a JSON string, quotes and all."""
    pairs = [F.lit("ffi_source"), F.col("source_lang"), F.lit("ffi_target"), F.col("target_lang"), F.lit("ffi_kind"), F.concat(F.lit('"'), F.col("kind"), F.lit('"'))]
    full = F.create_map(*pairs, F.lit("ffi_signature"), F.col("native_signature"))
    return F.when(F.col("native_signature").isNull(), F.create_map(*pairs)).otherwise(full)


def link_ffi(bindings: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A feature node for each binding, and the edges from its file: bindings carry ``node_id``."""
    nodes = bindings.select("node_id", F.lit("feature").alias("category"), F.lit("ffi_binding").alias("kind"), F.col("source_lang").alias("language"), F.col("symbol").alias("name"))
    sources = files.select(F.col("path").alias("_fp"), F.col("node_id").alias("src"))
    edges = bindings.join(sources, F.col("path") == F.col("_fp")).select("src", F.col("node_id").alias("dst"), F.lit("ffi_binding").alias("edge_type"), ffi_metadata(bindings).alias("metadata"))
    return nodes, edges


def link_all(phases: list[DataFrame]) -> DataFrame:
    """The edges of all passes with ``phase`` and ``turn``; by these two, edges are in the order of linking."""
    out = None
    for i, edges in enumerate(phases):
        metadata = F.col("metadata") if "metadata" in edges.columns else F.lit(None).cast("map<string,string>").alias("metadata")
        seq = F.col("seq") if "seq" in edges.columns else F.col("src")
        part = edges.select(F.lit(i).alias("phase"), seq.cast("bigint").alias("turn"), "src", "dst", "edge_type", metadata)
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def occurrence(by: list[str], order: list[str]) -> Column:
    """1, 2, 3 ... of the rows alike in ``by``."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
