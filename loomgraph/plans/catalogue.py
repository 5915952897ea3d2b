"""The queries of the graph engine over the canonical graph, and SQL of the same meaning for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import case
from loomgraph.operators import diff, enrich, evolve, explore, fetch, link, report, search
from loomgraph.plans import canonical, scratch
from loomgraph.plans.canonical import EDGES_SQL, FACTS_SQL, NODES_SQL, graph, table
from loomgraph.schema import EDGES, NODES, category_of_kind, edge_view
from loomgraph.sources import facts, store
from loomgraph.sources.parsers import docs, ffi
from loomgraph.sources.parsers.builtins import BUILTINS, COMMON_METHODS, is_common_method, without_builtins
from loomgraph.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

GRAPH = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}"
FACTS = f"WITH {FACTS_SQL}"
REVERSED = ", ".join(f"'{t}'" for t in report.REVERSED)


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


def on_graph(name: str, sql: str | None, query: Callable) -> None:
    register(name, None if sql is None else f"{GRAPH} {sql}")(lambda spark, d: query(graph(spark, d)))


# Reports

on_graph("node_category_counts", "SELECT category, count(*) AS n FROM nodes GROUP BY category", report.category_counts)
on_graph("edge_type_counts", "SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type", report.edge_type_counts)
VIEW = "CASE WHEN edge_type IN ('belongs_to_feature', 'implements_feature', 'contains_feature') THEN 'functional' ELSE 'dependency' END"
on_graph("edge_view_counts", f"SELECT {VIEW} AS edge_view, count(*) AS n FROM edges GROUP BY 1", report.edge_view_counts)
on_graph("languages", "SELECT DISTINCT language FROM nodes WHERE language <> ''", report.languages)
on_graph("node_edge_counts", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges", lambda g: g.counts())
on_graph("graph_summary", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT array_to_string(list_sort(list(DISTINCT language)), ',') FROM nodes WHERE language <> '') AS languages", lambda g: report.summary(g).withColumn("languages", F.array_join("languages", ",")))
on_graph("reverse_deps", f"SELECT node_id, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM nodes LEFT JOIN (SELECT dst, count(*) AS n, CAST(sum(src) AS BIGINT) AS total FROM edges WHERE edge_type IN ({REVERSED}) GROUP BY dst) ON dst = node_id", lambda g: report.reverse_dependencies(g).select("node_id", F.size("dependents").cast("bigint").alias("n"), F.aggregate("dependents", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total")))
on_graph("dependents_of", f"SELECT dst AS node_id, src AS dependent FROM edges WHERE edge_type IN ({REVERSED}) AND dst = (SELECT min(node_id) FROM nodes WHERE category = 'type')", lambda g: report.dependents_of(g, g.nodes.where("category = 'type'").agg(F.min("node_id")).first()[0]).select("node_id", F.explode("dependents").alias("dependent")))


@register("import_resolution_rate", f"{FACTS} SELECT (SELECT count(*) FROM imp) AS imports, (SELECT count(*) FROM imp JOIN bare USING (name)) AS resolved, round((SELECT count(*) FROM imp JOIN bare USING (name)) / (SELECT count(*) FROM imp), 6) AS rate")
def import_resolution_rate(spark: SparkSession, d: str) -> DataFrame:
    return report.import_resolution(_imports_linked(spark, d)).withColumn("rate", F.round("rate", 6))


def _imports_linked(spark: SparkSession, d: str) -> store.CodeGraph:
    made = canonical.imports(spark, d)
    nodes = made.select("node_id", F.lit("import").alias("category"))
    return store.CodeGraph(nodes, link.link_imports(made, canonical.definitions(spark, d)).select("src", "dst", "edge_type"))


@register("validation_report", f"{FACTS} SELECT (SELECT count(*) FROM imp) AS total_nodes, (SELECT count(*) FROM imp JOIN bare USING (name)) AS total_edges, 0::BIGINT AS calls, 0::BIGINT AS implements, 0::BIGINT AS ffi_bindings, (SELECT count(*) FROM imp) AS imports, (SELECT count(*) FROM imp JOIN bare USING (name)) AS resolved, NULL::VARCHAR AS warning")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return report.validation(_imports_linked(spark, d)).drop("rate")


# Lookups and adjacency

on_graph("find_by_name", "SELECT name, min_by(node_id, node_seq) AS node_id, count(*) AS matches FROM nodes GROUP BY name", lambda g: g.first_by("name"))
on_graph("find_by_name_and_category", "SELECT name, category, min_by(node_id, node_seq) AS node_id, count(*) AS matches FROM nodes GROUP BY ALL", lambda g: g.first_by("name", "category"))
on_graph("find_by_path", "SELECT path, min_by(node_id, node_seq) AS node_id, count(*) AS matches FROM nodes WHERE path IS NOT NULL GROUP BY path", lambda g: g.first_by("path"))
on_graph("find_in_file", "SELECT path, name, min_by(node_id, node_seq) AS node_id, count(*) AS matches FROM nodes WHERE path IS NOT NULL GROUP BY path, name", lambda g: g.first_by("path", "name"))
on_graph("find_one", "SELECT node_id, path FROM nodes WHERE name = 'small_ring_11' ORDER BY node_seq LIMIT 1", lambda g: g.find(name="small_ring_11").select("node_id", "path"))
on_graph("nodes_for_file", "SELECT node_id, name FROM nodes WHERE path = 'AMERICA/NATION_1'", lambda g: g.nodes_for_file("AMERICA/NATION_1").select("node_id", "name"))
on_graph("node_by_id", "SELECT node_id, name, category FROM nodes WHERE node_id = 3000007", lambda g: g.node(3000007).select("node_id", "name", "category"))
on_graph("high_level_nodes", "SELECT node_id, name FROM nodes WHERE node_level = 'high'", lambda g: g.of_level("high").select("node_id", "name"))
on_graph("low_level_nodes", "SELECT node_id FROM nodes WHERE node_level = 'low'", lambda g: g.of_level("low").select("node_id"))
on_graph("functional_centroids", "SELECT node_id FROM nodes WHERE node_level = 'high' AND kind = 'functional_centroid' UNION ALL SELECT max(node_id) + 1 FROM nodes", lambda g: g.add_centroid("new", "all things").functional_centroids().select("node_id"))
on_graph("node_exists", "SELECT node_id FROM nodes WHERE name <> ''", lambda g: g.node_exists())
on_graph("children_of", "SELECT src AS node_id, dst AS other_id, edge_seq FROM edges WHERE edge_type = 'contains'", lambda g: g.children().drop("edge_type"))
on_graph("successors", "SELECT src AS node_id, dst AS other_id, edge_seq, edge_type FROM edges", lambda g: g.successors())
on_graph("predecessors", "SELECT dst AS node_id, src AS other_id, edge_seq, edge_type FROM edges", lambda g: g.predecessors())
on_graph("neighbors", "SELECT node_id, count(*) AS n FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node_id", lambda g: g.successors().unionAll(g.predecessors()).groupBy("node_id").agg(F.count("*").alias("n")))
on_graph("edges_from", "SELECT src AS node_id, edge_type, count(*) AS n, min(dst) AS least FROM edges GROUP BY ALL", lambda g: g.successors().groupBy("node_id", "edge_type").agg(F.count("*").alias("n"), F.min("other_id").alias("least")))
on_graph("edges_to", "SELECT dst AS node_id, edge_type, count(*) AS n, min(src) AS least FROM edges GROUP BY ALL", lambda g: g.predecessors().groupBy("node_id", "edge_type").agg(F.count("*").alias("n"), F.min("other_id").alias("least")))
on_graph("edges_involving", "SELECT src AS node_id, edge_seq, dst AS other_id, edge_type, 'outgoing' AS direction FROM edges UNION ALL SELECT dst, edge_seq, src, edge_type, 'incoming' FROM edges WHERE src <> dst", lambda g: g.edges_involving())
on_graph("edge_between", "SELECT src, dst, max(edge_seq) AS edge_seq, max_by(edge_type, edge_seq) AS edge_type, count(*) AS parallel FROM edges GROUP BY src, dst", lambda g: g.edge_between())
on_graph("centroid_members", "SELECT dst AS node_id, src AS other_id FROM edges WHERE edge_type = 'belongs_to_feature'", lambda g: g.centroid_members().select("node_id", "other_id"))
PLACED = "SELECT *, 'd' || (node_id % 5) AS b, 'd' || (node_id % 7) AS c FROM nodes WHERE node_id >= 3000000"
on_graph(
    "ground_centroids",
    f"""SELECT dst AS node_id, CASE WHEN count(*) > 1 AND count(DISTINCT b) > 1 THEN 'src' WHEN count(*) > 1 AND count(DISTINCT c) > 1 THEN 'src/' || min(b) ELSE 'src/' || min(b) || '/' || min(c) END AS path,
string_agg(semantic_feature, '; ' ORDER BY edge_seq) AS semantic_feature FROM edges JOIN ({PLACED}) ON src = node_id WHERE edge_type = 'belongs_to_feature' GROUP BY dst""",
    lambda g: store.CodeGraph(g.nodes.withColumn("path", F.when(F.col("node_id") >= 3000000, F.expr("concat('src/d', node_id % 5, '/d', node_id % 7, '/', node_id, '.rs')"))), g.edges).ground_centroids(),
)


@register(
    "common_ancestor",
    f"""{GRAPH}, f AS (SELECT split_part(path, '/', 1) AS r, split_part(path, '/', 2) AS n FROM nodes WHERE category = 'file')
SELECT r AS category, CASE WHEN count(DISTINCT n) > 1 THEN r ELSE r || '/' || min(n) END AS ancestor FROM f GROUP BY r
UNION ALL SELECT '', CASE WHEN count(DISTINCT r) > 1 THEN '' WHEN count(DISTINCT n) > 1 THEN min(r) ELSE min(r) || '/' || min(n) END FROM f""",
)
def common_ancestor_(spark: SparkSession, d: str) -> DataFrame:
    """Of the files of each region, and of all files."""
    from loomgraph.graph import common_ancestor

    files = graph(spark, d).nodes.where("category = 'file'").select("path", F.explode(F.array(F.substring_index("path", "/", 1), F.lit(""))).alias("category"))
    return files.groupBy("category").agg(F.collect_list("path").alias("paths")).select("category", common_ancestor(F.col("paths")).alias("ancestor"))


# Changes

FIRST_FILES = "SELECT path FROM nodes WHERE category = 'file' AND language = 'building'"


def _some_files(g: store.CodeGraph) -> DataFrame:
    return g.nodes.where("category = 'file' AND language = 'building'").select("path")


on_graph("remove_file_nodes", f"SELECT edge_type, count(*) AS n FROM edges WHERE src NOT IN (SELECT node_id FROM nodes WHERE path IN ({FIRST_FILES})) AND dst NOT IN (SELECT node_id FROM nodes WHERE path IN ({FIRST_FILES})) GROUP BY edge_type", lambda g: report.edge_type_counts(g.remove_file_nodes(_some_files(g))))
on_graph("remove_edges_for_nodes", "SELECT edge_seq FROM edges WHERE src NOT IN (SELECT node_id FROM nodes WHERE category = 'type') AND dst NOT IN (SELECT node_id FROM nodes WHERE category = 'type')", lambda g: g.without_edges_of(g.nodes.where("category = 'type'").select("node_id")).select("edge_seq"))
on_graph("remove_node", "SELECT edge_type, count(*) AS n FROM edges WHERE src <> 3000007 AND dst <> 3000007 GROUP BY edge_type", lambda g: report.edge_type_counts(g.remove_nodes(g.node(3000007).select("node_id"))))
on_graph("retain_edges", "SELECT edge_seq, src, dst FROM edges WHERE edge_type <> 'calls' AND src < dst", lambda g: g.retain_edges((F.col("edge_type") != "calls") & (F.col("src") < F.col("dst"))).edges.select("edge_seq", "src", "dst"))
on_graph("remove_edge_between", "SELECT count(*) AS n FROM edges WHERE edge_seq <> (SELECT max(edge_seq) FROM edges WHERE src = 0 AND dst = 100)", lambda g: g.remove_edge_between(0, 100).edges.agg(F.count("*").alias("n")))
on_graph("cleanup_orphans", "SELECT edge_type, count(*) AS n FROM edges WHERE src IN (SELECT node_id FROM nodes WHERE category <> 'function') AND dst IN (SELECT node_id FROM nodes WHERE category <> 'function') GROUP BY edge_type", lambda g: report.edge_type_counts(store.CodeGraph(g.nodes.where("category <> 'function'"), g.edges).cleanup_orphans()))
on_graph("add_nodes", "SELECT node_id, name FROM nodes UNION ALL SELECT (SELECT max(node_id) FROM nodes) + row_number() OVER (ORDER BY node_seq), 'new_' || name FROM nodes WHERE category = 'directory'", lambda g: g.add_nodes(g.nodes.where("category = 'directory'").withColumn("name", F.concat(F.lit("new_"), "name"))).nodes.select("node_id", "name"))
on_graph("add_edges", "SELECT count(*) AS n FROM (SELECT src FROM edges UNION ALL SELECT src FROM edges WHERE edge_type = 'contains' AND dst IN (SELECT node_id FROM nodes) AND src + 100 IN (SELECT node_id FROM nodes))", lambda g: g.add_edges(g.edges.where("edge_type = 'contains'").withColumn("src", F.col("src") + 100)).edges.agg(F.count("*").alias("n")))
on_graph("update_semantics", "SELECT node_id, CASE WHEN category = 'file' THEN 'about ' || name ELSE description END AS description FROM nodes", lambda g: store.CodeGraph(g.nodes.withColumns({"features": F.array().cast("array<string>"), "feature_path": F.lit(None).cast("string")}), g.edges).update_semantics(g.nodes.where("category = 'file'").select("node_id", F.concat(F.lit("about "), "name").alias("description"), F.lit(None).cast("array<string>").alias("features"), F.lit("x").alias("feature_path"))).nodes.select("node_id", "description"))

# Linking

register("kind_to_category", "SELECT k AS kind, CASE WHEN k = 'fn' THEN 'function' WHEN k IN ('struct', 'enum', 'trait', 'type', 'class', 'interface') THEN 'type' WHEN k IN ('mod', 'module') THEN 'module' WHEN k IN ('const', 'constant') THEN 'constant' ELSE 'variable' END AS category, count(*) AS n FROM (SELECT CASE p_size % 8 WHEN 0 THEN 'fn' WHEN 1 THEN 'struct' WHEN 2 THEN 'mod' WHEN 3 THEN 'const' WHEN 4 THEN 'func' WHEN 5 THEN 'interface' WHEN 6 THEN 'impl' ELSE 'def' END AS k FROM part) GROUP BY ALL")(
    lambda spark, d: table(spark, d, "part").select(F.get(F.array(*[F.lit(k) for k in ("fn", "struct", "mod", "const", "func", "interface", "impl", "def")]), F.col("p_size") % 8).alias("kind")).select("kind", category_of_kind(F.col("kind")).alias("category")).groupBy("kind", "category").agg(F.count("*").alias("n"))
)


@register("dir_file_nodes", f"WITH f AS (SELECT r_name || '/' || n_name || '/' || c_name AS path, r_name || '/' || n_name AS parent, lower(c_mktsegment) AS language, c_custkey AS seq, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT 'repository' AS category, 'unknown' AS language, 'root' AS name, 'root' AS path UNION ALL SELECT 'directory', min_by(language, seq), split_part(parent, '/', 2), parent FROM f GROUP BY parent UNION ALL SELECT 'file', language, name, path FROM f")
def dir_file_nodes(spark: SparkSession, d: str) -> DataFrame:
    files = canonical.nodes(spark, d).where("category = 'file'").selectExpr("path", "language", "node_seq AS seq")
    return link.file_nodes(files, "root").select("category", "language", "name", "path")


@register("symbol_index", f"{FACTS} SELECT name, node_id, many AS candidates FROM bare")
def symbol_index(spark: SparkSession, d: str) -> DataFrame:
    return link.bare_index(canonical.definitions(spark, d))


@register("qualified_index", f"{FACTS} SELECT path, name, node_id FROM qual")
def qualified_index(spark: SparkSession, d: str) -> DataFrame:
    return link.qualified_index(canonical.definitions(spark, d))


@register("link_imports", f"{FACTS} SELECT imp.node_id AS src, bare.node_id AS dst, 'references' AS edge_type FROM imp JOIN bare USING (name)")
def link_imports(spark: SparkSession, d: str) -> DataFrame:
    return link.link_imports(canonical.imports(spark, d), canonical.definitions(spark, d)).select("src", "dst", "edge_type")


RESOLVED = """coalesce(q.node_id, CASE WHEN w.name IS NOT NULL THEN b.node_id END, CASE WHEN b.many = 1 THEN b.node_id END)"""
RESOLVE = """LEFT JOIN qual q ON q.path = c.path AND q.name = c.name LEFT JOIN brought w ON w.path = c.path AND w.name = c.name LEFT JOIN bare b ON b.name = c.name"""


@register("resolution_outcomes", f"{FACTS} SELECT CASE WHEN q.node_id IS NOT NULL THEN 'same_file' WHEN w.name IS NOT NULL THEN 'import' WHEN b.many = 1 THEN 'unique' ELSE 'unresolved' END AS how, count(*) AS n FROM called c {RESOLVE} GROUP BY how")
def resolution_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return link.resolve(canonical.calls(spark, d), "callee", canonical.definitions(spark, d), canonical.imports(spark, d)).groupBy("how").agg(F.count("*").alias("n"))


@register(
    "link_calls",
    f"""{FACTS}, home AS (SELECT name, min_by(path, node_seq) AS home FROM def WHERE kind = 'struct' GROUP BY name)
SELECT c.seq, f.node_id AS src, coalesce(t.node_id, {RESOLVED}) AS dst FROM called c {RESOLVE}
LEFT JOIN home h ON h.name = c.receiver LEFT JOIN qual t ON t.path = h.home AND t.name = c.name
JOIN (SELECT CAST(c_custkey AS VARCHAR) AS path, 2000000 + c_custkey AS node_id FROM customer) f ON f.path = c.path
WHERE coalesce(t.node_id, {RESOLVED}) IS NOT NULL""",
)
def link_calls(spark: SparkSession, d: str) -> DataFrame:
    types = canonical.definitions(spark, d).where("kind = 'struct'")
    return link.link_calls(canonical.calls(spark, d), canonical.definitions(spark, d), canonical.imports(spark, d), canonical.files(spark, d), types).select("seq", "src", "dst")


@register("link_type_refs", f"{FACTS} SELECT c.seq, f.node_id AS src, {RESOLVED} AS dst, 'uses_type' AS edge_type FROM called c {RESOLVE} JOIN (SELECT CAST(c_custkey AS VARCHAR) AS path, 2000000 + c_custkey AS node_id FROM customer) f ON f.path = c.path WHERE {RESOLVED} IS NOT NULL")
def link_type_refs(spark: SparkSession, d: str) -> DataFrame:
    refs = canonical.calls(spark, d).withColumnRenamed("callee", "type_name")
    return link.link_type_refs(refs, canonical.definitions(spark, d), canonical.imports(spark, d), canonical.files(spark, d)).select("seq", "src", "dst", "edge_type")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as types whose base is named by their brand, and as traits and their implementations."""
    return table(spark, d, "part").selectExpr("p_partkey AS node_id", "p_partkey AS node_seq", "p_brand AS name", "CASE p_size % 3 WHEN 0 THEN 'trait' WHEN 1 THEN 'impl_trait' ELSE 'class' END AS kind", "'type' AS category", "map('trait', concat('\"', p_brand, '\"'), 'bases', concat('[\"', p_brand, '\",\"', p_type, '\"]')) AS metadata")


PARTS = "p AS (SELECT p_partkey AS id, p_brand AS name, CASE p_size % 3 WHEN 0 THEN 'trait' WHEN 1 THEN 'impl_trait' ELSE 'class' END AS kind FROM part)"
register("link_impls", f"WITH {PARTS}, t AS (SELECT name, max(id) AS dst FROM p WHERE kind = 'trait' GROUP BY name) SELECT id AS src, dst, 'implements' AS edge_type FROM p JOIN t USING (name) WHERE kind = 'impl_trait'")(lambda spark, d: link.link_impls(_classes(spark, d)))
register("link_extends", f"WITH {PARTS}, t AS (SELECT name, max(id) AS dst FROM p GROUP BY name) SELECT id AS src, dst, 'extends' AS edge_type FROM p JOIN t USING (name)")(lambda spark, d: link.link_extends(_classes(spark, d)))


@register("link_ffi", "SELECT 2000000 + c_custkey AS src, c_custkey AS dst, 'ffi_binding' AS edge_type, '\"Import\"' AS ffi_kind FROM customer")
def link_ffi(spark: SparkSession, d: str) -> DataFrame:
    bindings = table(spark, d, "customer").selectExpr("cast(c_custkey AS string) AS path", "c_custkey AS node_id", "c_name AS symbol", "'rust' AS source_lang", "'C' AS target_lang", "'Import' AS kind", "cast(NULL AS string) AS native_signature")
    return link.link_ffi(bindings, canonical.files(spark, d))[1].select("src", "dst", "edge_type", F.col("metadata")["ffi_kind"].alias("ffi_kind"))


@register("stop_list_filter", f"SELECT event_type AS callee, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'iter' WHEN 'click' THEN 'push' WHEN 'error' THEN 'unwrap' ELSE event_type END AS event_type FROM events) WHERE event_type NOT IN ({', '.join(repr(x) for x in sorted(COMMON_METHODS))}) GROUP BY event_type")
def stop_list_filter(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "events").select(F.expr("CASE event_type WHEN 'view' THEN 'iter' WHEN 'click' THEN 'push' WHEN 'error' THEN 'unwrap' ELSE event_type END").alias("callee"))
    return named.where(~is_common_method(F.col("callee"))).groupBy("callee").agg(F.count("*").alias("n"))


@register("builtin_filter", f"SELECT w AS type_name, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w NOT IN ({', '.join(repr(x) for x in sorted(BUILTINS['python']))}) GROUP BY w")
def builtin_filter(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.lit("python").alias("language"), F.explode(F.split("text", " ")).alias("type_name"))
    return without_builtins(words).groupBy("type_name").agg(F.count("*").alias("n"))


# Exploration


def reach(start: str, step: str, most: int | None, emit: str = "TRUE") -> str:
    bound = "" if most is None else f" AND r.depth < {most}"
    return f"{GRAPH}, hop AS (SELECT DISTINCT * FROM ({step})), r AS (SELECT node_id AS start, node_id, 0 AS depth FROM nodes WHERE {start} AND {emit} UNION SELECT r.start, n.node_id, r.depth + 1 FROM r JOIN hop ON hop.here = r.node_id JOIN nodes n ON n.node_id = hop.there WHERE {emit.replace('category', 'n.category')}{bound}) SELECT start, node_id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY start, node_id"


DEPENDS = "edge_type IN ('calls', 'imports', 'depends_on')"


def _starts(g: store.CodeGraph, condition: str) -> DataFrame:
    return g.nodes.where(condition).select(F.col("node_id").alias("start"))


on_graph("explore_containment", None, lambda g: explore.containment(g, _starts(g, "category = 'repository'")).nodes)
SQL["explore_containment"] = reach("category = 'repository'", "SELECT src AS here, dst AS there FROM edges WHERE edge_type = 'contains'", None)
on_graph("explore_dependencies", None, lambda g: explore.dependencies(g, _starts(g, "category = 'file'"), 2).nodes)
SQL["explore_dependencies"] = reach("category = 'file'", f"SELECT src AS here, dst AS there FROM edges WHERE {DEPENDS}", 2)
on_graph("explore_dependents", None, lambda g: explore.dependents(g, _starts(g, "category = 'function'"), 2).nodes)
SQL["explore_dependents"] = reach("category = 'function'", f"SELECT dst AS here, src AS there FROM edges WHERE {DEPENDS}", 2)
on_graph("explore_both", None, lambda g: explore.explore(g, _starts(g, "category = 'directory'"), "both", explore.Filter(edge_types=("contains", "extends"), max_depth=3)).nodes)
SQL["explore_both"] = reach("category = 'directory'", "SELECT src AS here, dst AS there FROM edges WHERE edge_type IN ('contains', 'extends') UNION ALL SELECT dst, src FROM edges WHERE edge_type IN ('contains', 'extends')", 3)
on_graph("explore_filtered", None, lambda g: explore.explore(g, _starts(g, "category = 'type'"), "outgoing", explore.Filter(categories=("type",), view="dependency", max_depth=6)).nodes)
SQL["explore_filtered"] = reach("category = 'type'", f"SELECT src AS here, dst AS there FROM edges WHERE {VIEW} = 'dependency'", 6, "category = 'type'")
on_graph("explore_tree_edges", None, lambda g: explore.containment(g, _starts(g, "category = 'repository'")).edges.select("start", "src", "dst", "depth"))
SQL["explore_tree_edges"] = f"{GRAPH}, r AS (SELECT node_id AS start, NULL::BIGINT AS src, node_id AS dst, 0 AS depth FROM nodes WHERE category = 'repository' UNION ALL SELECT r.start, e.src, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.dst AND edge_type = 'contains') SELECT start, src, dst, depth FROM r WHERE depth > 0"
on_graph("explore_limited", None, lambda g: explore.explore(g, _starts(g, "category = 'repository'"), "outgoing", explore.Filter(edge_types=("contains",), limit=40)).nodes)
SQL["explore_limited"] = f"""{GRAPH}, r AS (SELECT node_id AS start, node_id, 0 AS depth, [0::BIGINT] AS turn FROM nodes WHERE category = 'repository' UNION ALL SELECT r.start, e.dst, r.depth + 1, list_append(r.turn, -e.edge_seq) FROM r JOIN edges e ON e.src = r.node_id AND edge_type = 'contains')
SELECT start, node_id, depth FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, turn) AS place FROM r) WHERE place <= 40"""
on_graph("explore_functional_area", "SELECT DISTINCT a.src AS start, b.src AS node_id FROM edges a JOIN edges b ON a.dst = b.dst AND b.edge_type = 'belongs_to_feature' WHERE a.edge_type = 'belongs_to_feature'", lambda g: explore.functional_area(g, _starts(g, "node_level = 'low'")))

# Search

TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), F.col("doc_id").alias("node_seq"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("description"), F.array("lang", "source").alias("features"), F.lit("file").alias("category"), F.lit("low").alias("node_level"))


def _search_sql(query: str, least: float, limit: int) -> str:
    asked = sorted(set(query.lower().split()))
    q = "[" + ", ".join(f"'{t}'" for t in asked) + "]"
    score = lambda t: f"(CASE WHEN len({t}) = 0 THEN 0 ELSE len(list_intersect({t}, {q})) / (len({t}) + {len(asked)} - len(list_intersect({t}, {q}))) END)::FLOAT"
    return f"""WITH t AS (SELECT doc_id, {TOKENS.format("'doc_' || doc_id")} AS n, {TOKENS.format('text')} AS d, [lower(lang)] AS l, [lower(source)] AS s FROM documents),
m AS (SELECT doc_id, {score('n')} AS n, {score('d')} AS d, greatest({score('l')}, {score('s')}) AS f FROM t)
SELECT doc_id AS node_id, round(greatest(n, d, f)::DOUBLE, 5) AS score, CASE WHEN greatest(n, d, f) = 0 THEN '' WHEN n = greatest(n, d, f) THEN 'name' WHEN d = greatest(n, d, f) THEN 'description' ELSE 'features' END AS matched_field
FROM m WHERE greatest(n, d, f) >= {least}::FLOAT ORDER BY greatest(n, d, f) DESC, doc_id LIMIT {limit}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round(F.col("score").cast("double"), 5))


register("search_jaccard", _search_sql("the of and", 0.02, 10))(lambda spark, d: _rounded(search.search(_texts(spark, d), "the of and", 10, 0.02)))
register("search_features", _search_sql("SRC3", 0.3, 20))(lambda spark, d: _rounded(search.search(_texts(spark, d), "SRC3", 20)))
on_graph("search_substring", "SELECT node_id, name FROM nodes WHERE contains(lower(name), 'ring') AND kind = 'struct' AND category = 'type' ORDER BY node_seq LIMIT 50", lambda g: search.by_substring(g.nodes, "RING", "struct", "typedef").select("node_id", "name"))
on_graph("search_filtered", "SELECT node_id FROM nodes WHERE category IN ('type', 'component') AND node_level <> 'high'", lambda g: search.filtered(g.nodes, ("type", "component"), include_high=False).select("node_id"))


@register(
    "similarity_pairs",
    """WITH d AS (SELECT doc_id, {} AS t FROM documents), b AS (SELECT item_id, {} AS t FROM benchmark)
SELECT doc_id, item_id, round((len(list_intersect(d.t, b.t)) / (len(d.t) + len(b.t) - len(list_intersect(d.t, b.t))))::FLOAT::DOUBLE, 5) AS score FROM d, b
WHERE (len(list_intersect(d.t, b.t)) / (len(d.t) + len(b.t) - len(list_intersect(d.t, b.t))))::FLOAT >= 0.3::FLOAT""".format(TOKENS.format("text"), TOKENS.format("text")),
)
def similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    side = lambda name, key, to: table(spark, d, name).select(F.col(key).alias(to), search.tokens(F.col("text")).alias("tokens"))
    return _rounded(search.similar_pairs(side("documents", "doc_id", "a"), side("benchmark", "item_id", "b"), 0.3)).withColumnsRenamed({"a": "doc_id", "b": "item_id"})


# Service listings

on_graph("edge_infos", "SELECT node_id, direction, edge_type, edge_seq, other_id, name AS other_name, category AS other_category FROM (SELECT src AS node_id, 'outgoing' AS direction, edge_type, edge_seq, dst AS other_id FROM edges UNION ALL SELECT dst, 'incoming', edge_type, edge_seq, src FROM edges) JOIN (SELECT node_id AS o, name, category FROM nodes) ON o = other_id", fetch.edge_infos)
on_graph("parents", "SELECT dst AS node_id, src AS parent_id, edge_seq FROM edges JOIN (SELECT src, dst FROM edges GROUP BY src, dst HAVING max_by(edge_type, edge_seq) = 'contains') USING (src, dst)", fetch.parents)
on_graph("functional_centroid", "SELECT src AS node_id, max_by(dst, edge_seq) AS centroid_id FROM edges WHERE edge_type = 'belongs_to_feature' GROUP BY src", fetch.functional_centroid)
on_graph(
    "fetch_detail",
    "SELECT node_id, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) AS outgoing, coalesce(c.n, 0) AS children, coalesce(m.n, 0) AS members, z.centroid_id FROM nodes LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = node_id LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = node_id LEFT JOIN (SELECT src, count(*) AS n FROM edges WHERE edge_type = 'contains' GROUP BY src) c ON c.src = node_id LEFT JOIN (SELECT dst, count(*) AS n FROM edges WHERE edge_type = 'belongs_to_feature' GROUP BY dst) m ON m.dst = node_id LEFT JOIN (SELECT src, max_by(dst, edge_seq) AS centroid_id FROM edges WHERE edge_type = 'belongs_to_feature' GROUP BY src) z ON z.src = node_id",
    lambda g: fetch.details(g).select("node_id", *[F.size(c).cast("bigint").alias(c) for c in ("incoming", "outgoing", "children", "members")], "centroid_id"),
)
on_graph("skeleton", "SELECT path, node_id AS file_id, coalesce(child_count, 0) AS child_count, coalesce(children, '') AS children FROM nodes LEFT JOIN (SELECT e.src, count(*) AS child_count, string_agg(n.name, ',' ORDER BY n.node_seq, n.name) AS children FROM edges e JOIN nodes n ON n.node_id = e.dst WHERE edge_type = 'contains' GROUP BY e.src) ON src = node_id WHERE category = 'file'", lambda g: fetch.skeleton(g).withColumn("children", F.array_join("children", ",")))
on_graph("get_edges", "SELECT edge_seq, src, dst FROM edges WHERE edge_type = 'contains' AND src = 0", lambda g: fetch.get_edges(g, source=0, edge_type="Contains", limit=None).select("edge_seq", "src", "dst"))
on_graph("get_edges_unknown_type", "SELECT edge_seq FROM edges ORDER BY edge_seq LIMIT 100", lambda g: fetch.get_edges(g, edge_type="no_such_type").select("edge_seq"))
on_graph("features", "SELECT node_id, description FROM nodes WHERE description <> ''", lambda g: fetch.with_features(store.CodeGraph(g.nodes.withColumn("features", F.array().cast("array<string>")), g.edges), limit=None).select("node_id", "description"))
on_graph("components", "SELECT node_id, name FROM nodes WHERE category = 'component' ORDER BY node_seq LIMIT 100", lambda g: fetch.components(g).select("node_id", "name"))
on_graph("edge_views", f"SELECT edge_seq, {VIEW} AS edge_view FROM edges", lambda g: g.edges.select("edge_seq", edge_view(F.col("edge_type")).alias("edge_view")))

# Differences: the old tree is the documents; the new one lacks French ones, has pages, and other texts of one source

OLD = "o AS (SELECT 'doc/' || doc_id AS path, text AS content FROM documents)"
NEW = "n AS (SELECT 'doc/' || doc_id AS path, CASE WHEN source = 'src3' THEN text || chr(10) || 'end' ELSE text END AS content FROM documents WHERE lang <> 'fr' UNION ALL SELECT 'page/' || page_id, html FROM pages)"
DIFF = "d AS (SELECT path, CASE WHEN o.content IS NULL THEN 'added' WHEN n.content IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN n USING (path) WHERE o.content IS NULL OR n.content IS NULL OR o.content <> n.content)"


def _old(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("concat('doc/', doc_id) AS path", "text AS content")


def _new(spark: SparkSession, d: str) -> DataFrame:
    docs_ = table(spark, d, "documents").where("lang <> 'fr'").selectExpr("concat('doc/', doc_id) AS path", "CASE WHEN source = 'src3' THEN concat(text, '\\n', 'end') ELSE text END AS content")
    return docs_.unionAll(table(spark, d, "pages").selectExpr("concat('page/', page_id) AS path", "html AS content"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return diff.file_diff(diff.file_hashes(_old(spark, d)), diff.file_hashes(_new(spark, d)))


register("file_hash", f"WITH {OLD} SELECT path, sha256(content) AS hash FROM o")(lambda spark, d: diff.file_hashes(_old(spark, d)))
register("file_diff", f"WITH {OLD}, {NEW}, {DIFF} SELECT path, change FROM d")(_changes)
register("diff_stats", f"WITH {OLD}, {NEW}, {DIFF} SELECT change, count(*) AS n FROM d GROUP BY change")(lambda spark, d: diff.diff_stats(_changes(spark, d)))
register("dir_hash", "SELECT source, sha256(string_agg(doc_id::VARCHAR || '|' || sha256(text) || chr(10), '' ORDER BY doc_id::VARCHAR)) AS hash FROM documents GROUP BY source")(
    lambda spark, d: diff.directory_hash(table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")), by=["source"])
)
UNIT = "SELECT path, split_part(line, ' ', 1) AS name, CASE WHEN length(line) % 2 = 0 THEN 'function' ELSE 'struct' END AS unit_type, row_at AS start_line, sha256(line) AS hash FROM (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS row_at FROM {}) WHERE line <> ''"
UNITS = f"uo AS ({UNIT.format('o')}), un AS ({UNIT.format('n')}), ro AS (SELECT *, row_number() OVER (PARTITION BY path, name, unit_type ORDER BY start_line) AS nth FROM uo), rn AS (SELECT *, row_number() OVER (PARTITION BY path, name, unit_type ORDER BY start_line) AS nth FROM un), u AS (SELECT path, name, unit_type, nth::INTEGER AS nth, CASE WHEN ro.hash IS NULL THEN 'added' WHEN rn.hash IS NULL THEN 'deleted' WHEN ro.hash <> rn.hash THEN 'changed' ELSE 'unchanged' END AS change FROM ro FULL JOIN rn USING (path, name, unit_type, nth))"


def _line_units(files: DataFrame) -> DataFrame:
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line")).where("line <> ''")
    return lines.select("path", F.substring_index("line", " ", 1).alias("name"), F.when(F.length("line") % 2 == 0, "function").otherwise("struct").alias("unit_type"), (F.col("at") + 1).alias("start_line"), diff.content_hash(F.col("line")).alias("hash"))


register("unit_diff", f"WITH {OLD}, {NEW}, {UNITS} SELECT path, name, unit_type, nth, change FROM u")(lambda spark, d: diff.match_units(_line_units(_old(spark, d)), _line_units(_new(spark, d))))
register("modified_files", f"WITH {OLD}, {NEW}, {DIFF}, {UNITS} SELECT path, change FROM d WHERE change = 'modified' AND path IN (SELECT path FROM u WHERE u.change <> 'unchanged')")(lambda spark, d: diff.modified_files(_changes(spark, d), diff.match_units(_line_units(_old(spark, d)), _line_units(_new(spark, d)))))

# Evolution: the types are what changed


def _types(g: store.CodeGraph) -> DataFrame:
    return g.nodes.where("category = 'type'").select("node_id")


on_graph("invalidate_feature_edges", "SELECT edge_type, count(*) AS n FROM edges WHERE NOT (edge_type = 'belongs_to_feature' AND src IN (SELECT node_id FROM nodes WHERE category = 'type') AND dst IN (SELECT node_id FROM nodes WHERE node_level = 'high')) GROUP BY edge_type", lambda g: report.edge_type_counts(evolve.invalidate_feature_edges(g, _types(g))))
on_graph("invalidate_centroids", "SELECT node_id, CASE WHEN node_level = 'high' AND node_id IN (SELECT dst FROM edges WHERE src IN (SELECT node_id FROM nodes WHERE category = 'type')) THEN NULL ELSE semantic_feature END AS semantic_feature FROM nodes", lambda g: evolve.invalidate_centroids(store.CodeGraph(g.nodes, g.edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "edge_seq", "edge_type")), _types(g)).nodes.select("node_id", "semantic_feature"))
on_graph("recompute_centroids", "SELECT h.node_id, string_agg(l.semantic_feature, '; ' ORDER BY l.node_seq, l.semantic_feature) AS semantic_feature FROM nodes h JOIN (SELECT DISTINCT src, dst FROM edges) ON dst = h.node_id JOIN nodes l ON l.node_id = src WHERE h.node_level = 'high' AND l.semantic_feature IS NOT NULL GROUP BY h.node_id", lambda g: evolve.recompute_centroids(store.CodeGraph(g.nodes.withColumn("semantic_feature", F.when(F.col("node_level") != "high", F.col("semantic_feature"))), g.edges)))
BEST = """best AS (SELECT node_id, arg_max(centroid_id, (score, -centroid_id)) AS centroid_id, max(score)::INTEGER AS score FROM (
  SELECT n.node_id, c.node_id AS centroid_id, len(list_filter(string_split(c.semantic_feature, ' '), lambda w: w <> '')) AS score FROM nodes n, nodes c
  WHERE n.node_level = 'low' AND c.node_level = 'high' AND n.semantic_feature IS NOT NULL AND c.semantic_feature IS NOT NULL AND n.category IN ('type', 'function')
    AND len(list_filter(string_split(c.semantic_feature, ' '), lambda w: w <> '' AND contains(n.semantic_feature, w))) > 0) GROUP BY node_id)"""
on_graph("best_centroids", None, lambda g: evolve.best_centroids(g, g.nodes.where("category IN ('type', 'function')").select("node_id")))
SQL["best_centroids"] = f"{GRAPH}, {BEST} SELECT node_id, centroid_id, score FROM best"
on_graph("relink_features", None, lambda g: evolve.relink_features(g, g.nodes.where("category IN ('type', 'function')").select("node_id")))
SQL["relink_features"] = f"{GRAPH}, {BEST} SELECT node_id AS src, centroid_id AS dst, 'belongs_to_feature' AS edge_type FROM best WHERE (node_id, centroid_id) NOT IN (SELECT (src, dst) FROM edges)"
on_graph("deleted_files", f"SELECT (SELECT count(*) FROM nodes WHERE path IS NULL OR path NOT IN ({FIRST_FILES})) AS nodes, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT node_id FROM nodes WHERE path IN ({FIRST_FILES})) AND dst NOT IN (SELECT node_id FROM nodes WHERE path IN ({FIRST_FILES}))) AS edges", lambda g: evolve.deleted_files(store.CodeGraph(g.nodes.withColumn("features", F.array().cast("array<string>")), g.edges), _some_files(g)).counts())

# Store: events as a log of additions, removals and updates of users


@register("patch_replay", "SELECT user_id AS node_id, arg_max(event_type, seq) AS name FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events) GROUP BY user_id HAVING arg_max(event_type, seq) <> 'error'")
def patch_replay(spark: SparkSession, d: str) -> DataFrame:
    """An error removes the user's node, every other event adds it again under its type's name."""
    from loomgraph.graph import number

    log = number(table(spark, d, "events").select("ts", "event_id", "user_id", "event_type"), "seq", ["ts", "event_id"])
    node = F.struct(F.col("user_id").alias("node_id"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("path"))
    edge = F.lit(None).cast("struct<edge_seq:bigint,src:bigint,dst:bigint,edge_type:string>")
    patches = log.select("seq", F.when(F.col("event_type") == "error", "remove_node").otherwise("add_node").alias("op"), F.lit(None).cast("string").alias("path"), node.alias("node"), edge.alias("edge"))
    base = store.CodeGraph(spark.createDataFrame([], "node_id bigint, name string, path string"), spark.createDataFrame([], "edge_seq bigint, src bigint, dst bigint, edge_type string"))
    return store.replay(base, patches).nodes.select("node_id", "name")


on_graph("file_index", "SELECT path, count(*) AS n, min(node_id) AS first FROM nodes WHERE path IS NOT NULL GROUP BY path", lambda g: store.file_index(g).select("path", F.size("node_ids").cast("bigint").alias("n"), F.get("node_ids", F.lit(0)).alias("first")))
on_graph("to_json_export", "SELECT 'node_' || node_id AS id, name, category FROM nodes", lambda g: store.to_json(g).where("kind = 'node'").select(F.get_json_object("line", "$.id").alias("id"), F.get_json_object("line", "$.name").alias("name"), F.get_json_object("line", "$.category").alias("category")))
on_graph("dot_export", "SELECT CASE WHEN part = 2 THEN line END AS line, count(*) AS n FROM (SELECT 2 AS part, 'n' || src || ' -> n' || dst || ' [style=' || CASE edge_type WHEN 'contains' THEN 'dotted' WHEN 'calls' THEN 'solid' WHEN 'extends' THEN 'bold' ELSE 'solid' END || '];' AS line FROM edges WHERE edge_type <> 'imports') GROUP BY 1", lambda g: store.to_dot(g).where("part = 2").groupBy("line").agg(F.count("*").alias("n")))

# Names and enrichment

PASCAL = "array_to_string(list_transform(string_split_regex({}, '[_/-]'), lambda w: upper(w[1]) || lower(w[2:])), '{}')"
register("pascal_case", f"SELECT p_partkey, {PASCAL.format('replace(p_name, chr(32), chr(95))', '')} AS pascal, {PASCAL.format('replace(p_name, chr(32), chr(95))', ' ')} AS title FROM part")(lambda spark, d: table(spark, d, "part").select("p_partkey", case.pascal_case(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("pascal"), case.title_case(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("title")))


@register("organize_by_path", f"SELECT c_custkey, {PASCAL.format('c_mktsegment', '')} || '/' || {PASCAL.format('n_name', '')} || '/Misc/' || c_name AS feature_path, {PASCAL.format('c_mktsegment', '')} AS functional_area FROM customer JOIN nation ON c_nationkey = n_nationkey")
def organize_by_path(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # the nations of the world
    path, area = case.organize_by_path(F.concat(F.lit("./src/"), "c_mktsegment", F.lit("/"), "n_name", F.lit(".rs")), F.col("c_name"))
    return named.select("c_custkey", path.alias("feature_path"), area.alias("functional_area"))


# Text that looks like code, made of part names


def _code(spark: SparkSession, d: str, template: str) -> DataFrame:
    """(path, content): the template with %s for a part's name."""
    before, after = template.split("%s")
    return table(spark, d, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path"), F.concat(F.lit(before), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(after)).alias("content"))


for _name, (_detect, _template, _source, _target, _kind, _symbol) in ffi.EXAMPLES.items():
    register(f"ffi_{_name}", f"SELECT 'p/' || p_partkey AS path, '{_source}' AS source_lang, '{_target}' AS target_lang, {_symbol} AS symbol, '{_kind}' AS kind FROM (SELECT *, replace(p_name, ' ', '_') AS name FROM part)")(lambda spark, d, detect=_detect, template=_template: detect(_code(spark, d, template)).select("path", "source_lang", "target_lang", "symbol", "kind"))


@register("doc_block_cleanup", "SELECT p_partkey, p_name || chr(10) || 'second' AS doc FROM part")
def doc_block_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", docs.clean_block(F.concat(F.lit("/**\n * "), "p_name", F.lit("\n *\n * @param x y\n * second\n */"))).alias("doc"))


# Parsers: a program in each language that defines the part's name


PROGRAMS = {
    "rust": ("pub fn %s(a: i32) {}", "fn"),
    "python": ("import os\ndef %s(x):\n    return x\n", "def"),
    "go": ("package main\nfunc %s(a int) {\n}", "func"),
    "c": ("int %s(int a) {\n  return a;\n}", "fn"),
    "cpp": ("class %s {\n};", "class"),
    "javascript": ("function %s(a) { return a; }", "function"),
    "typescript": ("interface %s { a: number }", "interface"),
    "java": ("public class %s {\n}", "class"),
    "ruby": ("def %s(a)\n  a\nend", "method"),
    "lua": ("local function %s(a)\n  return a\nend", "local_function"),
    "swift": ("func %s(a: Int) {}", "func"),
    "haskell": ("%s x = x", "function"),
    "csharp": ("public class %s {\n}", "class"),
    "scala": ("object %s {\n}", "object"),
}


def _definitions(spark: SparkSession, d: str, language: str, template: str) -> DataFrame:
    parsed = facts.parse_files(_code(spark, d, template).withColumn("language", F.lit(language)))
    return facts.explode(parsed, "definitions").select("path", "kind", "name")


for _language, (_program, _kind) in PROGRAMS.items():
    register(f"parse_{_language}", f"SELECT 'p/' || p_partkey AS path, '{_kind}' AS kind, replace(p_name, ' ', '_') AS name FROM part")(lambda spark, d, language=_language, program=_program: _definitions(spark, d, language, program))


@register("line_count_units", "SELECT 'doc/' || doc_id AS path, source AS name, 'function' AS unit_type, 1 AS start_line, CAST(len(string_split(text, chr(10))) AS INTEGER) AS end_line, sha256(text) AS hash FROM documents")
def line_count_units(spark: SparkSession, d: str) -> DataFrame:
    """One unit a document, of all its lines."""
    definitions = table(spark, d, "documents").selectExpr("concat('doc/', doc_id) AS path", "source AS name", "'fn' AS kind", "named_struct('start_line', 1, 'end_line', size(split(text, '\n'))) AS location")
    return diff.units(definitions, _old(spark, d))


register("node_index", "SELECT e.event_id AS node_id, 'u/' || e.user_id AS path, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS ordinal FROM events e")(
    lambda spark, d: diff.node_index(table(spark, d, "events").groupBy(F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path")).agg(F.sort_array(F.collect_list(F.struct(F.col("event_id").alias("node_id")))).alias("units")))
)
register("diagnostics", "SELECT 'p/' || p_partkey || ':' || p_size || ':' || 1 || ': error: ' || p_name AS line FROM part")(lambda spark, d: store.diagnostics(table(spark, d, "part").selectExpr("concat('p/', p_partkey) AS path", "p_size AS line", "1 AS column", "p_name AS error")))


# A source tree of suppliers: the file of each defines a function that calls that of another


NEXT = "7 * s_suppkey % (SELECT count(*) FROM supplier) + 1"
STREAM_SQL = f"""WITH f AS (SELECT s_suppkey AS k, {NEXT} AS j, 'n' || s_nationkey AS folder FROM supplier), live AS (SELECT *, CASE WHEN k % 3 = 0 THEN 't' ELSE 's' END || k AS name FROM f WHERE k % 5 <> 0)
SELECT 'contains' AS edge_type, folder AS source, k || '.py' AS target FROM live
UNION ALL SELECT 'contains', k || '.py', name FROM live
UNION ALL SELECT 'calls', a.k || '.py', b.name FROM live a JOIN live b ON a.j = b.k AND b.name = 's' || b.k"""


def _supplier_files(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "supplier").crossJoin(canonical._size(table(spark, d, "supplier"), "suppliers"))
    return counted.selectExpr("s_suppkey AS k", "concat('n', s_nationkey, '/', s_suppkey, '.py') AS path", "7 * s_suppkey % suppliers + 1 AS j")


def _named_edges(g: store.CodeGraph) -> DataFrame:
    ends = lambda end, to: g.nodes.select(F.col("node_id").alias(end), F.col("name").alias(to))
    return g.edges.join(ends("src", "source"), "src").join(ends("dst", "target"), "dst").select("edge_type", "source", "target")


@register("stream_update", STREAM_SQL)
def stream_update(spark: SparkSession, d: str) -> DataFrame:
    """A stream adds all files to an empty store; then a third is modified to define another name, and a fifth deleted."""
    folder = scratch.scratch_path(spark, "stream")
    made = store.Store(spark, f"{folder}/store")
    made.save_base(store.CodeGraph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)))
    files = _supplier_files(spark, d)
    first = files.selectExpr("path", "concat('def s', k, '():\n    return s', j, '()\n') AS content", "false AS deleted", "1 AS modified")
    then = files.where("k % 3 = 0 OR k % 5 = 0").selectExpr("path", "CASE WHEN k % 5 <> 0 THEN concat('# new\ndef t', k, '():\n    return s', j, '()\n') END AS content", "k % 5 = 0 AS deleted", "2 AS modified")
    for changes in (first, then):
        changes.write.mode("append").json(f"{folder}/changes")
        watch.watch(spark, f"{folder}/changes", made, f"{folder}/checkpoint", available_now=True).awaitTermination()
    return _named_edges(made.load())


# A source tree of customers, encoded: each file imports, refers to and calls what another one defines


RUST = """use crate::p%j::f%j;

/// Number %k.
pub struct S%k;

impl S%k {
    pub fn m%k(&self, other: S%j) -> S%k {
        f%j().m%j(f%k());
        hidden!("f%j()")
    }
}

pub fn f%k() {}
"""
FILE = "custs AS (SELECT c_custkey AS k, 7 * c_custkey % (SELECT count(*) FROM customer) + 1 AS j, 'src/n' || c_nationkey AS folder FROM customer), tree AS (SELECT *, folder || '/' || k || '.rs' AS path FROM custs)"


def _encoded(spark: SparkSession, d: str) -> store.CodeGraph:
    counted = table(spark, d, "customer").crossJoin(canonical._size(table(spark, d, "customer"), "files"))
    numbers = counted.selectExpr("concat('src/n', c_nationkey, '/', c_custkey, '.rs') AS path", "cast(c_custkey AS string) AS k", "cast(7 * c_custkey % files + 1 AS string) AS j")
    filled = F.replace(F.replace(F.lit(RUST), F.lit("%k"), F.col("k")), F.lit("%j"), F.col("j"))
    return facts.encode(numbers.select("path", F.lit("rust").alias("language"), filled.alias("content"))).graph


@register(
    "encode_nodes",
    f"""WITH {FILE} SELECT NULL AS path, 'repository' AS category, 'root' AS name, NULL AS line, NULL AS documentation
UNION ALL SELECT DISTINCT folder, 'directory', split_part(folder, '/', 2), NULL, NULL FROM tree
UNION ALL SELECT path, 'file', k || '.rs', NULL, NULL FROM tree
UNION ALL SELECT path, 'import', 'crate::p' || j || '::f' || j, 1, NULL FROM tree
UNION ALL SELECT path, 'type', 'S' || k, 4, 'Number ' || k || '.' FROM tree
UNION ALL SELECT path, 'variable', 'S' || k, 6, '' FROM tree
UNION ALL SELECT path, 'function', 'm' || k, 7, '' FROM tree
UNION ALL SELECT path, 'function', 'f' || k, 13, '' FROM tree""",
)
def encode_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = _encoded(spark, d).nodes
    return nodes.select(F.when(F.col("category") != "repository", F.col("path")).alias("path"), "category", "name", F.col("location.start_line").alias("line"), "documentation")


# A type reference finds the last definition of its file, or of the only file that has it the first.
@register(
    "encode_edges",
    f"""WITH {FILE} SELECT edge_type, source, target FROM (
SELECT 'contains' AS edge_type, split_part(folder, '/', 2) AS source, k || '.rs' AS target FROM tree
UNION ALL SELECT 'contains', k || '.rs', unnest(['crate::p' || j || '::f' || j, 'S' || k, 'S' || k, 'm' || k, 'f' || k]) FROM tree
UNION ALL SELECT 'references', 'crate::p' || j || '::f' || j, 'f' || j FROM tree WHERE j IN (SELECT k FROM custs)
UNION ALL SELECT 'calls', k || '.rs', unnest(['f' || j, 'm' || j]) FROM tree WHERE j IN (SELECT k FROM custs)
UNION ALL SELECT 'calls', k || '.rs', 'f' || k FROM tree
UNION ALL SELECT 'uses_type', k || '.rs', 'S' || k FROM tree
UNION ALL SELECT 'uses_type', k || '.rs', 'S' || j FROM tree WHERE j = k)""",
)
def encode_edges(spark: SparkSession, d: str) -> DataFrame:
    return _named_edges(_encoded(spark, d))


@register("find_by_location", f"WITH {FILE} SELECT path, unnest([1, 4, 6, 7, 13]) AS line, 1 AS matches FROM tree")
def find_by_location(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).first_by_location().select("path", "line", F.col("matches").cast("int").alias("matches"))


@register("encode_semantics", "SELECT p_partkey AS node_id, 'handle ' || replace(p_name, ' ', '_') AS feature, 'about ' || replace(p_name, ' ', '_') AS description FROM part")
def encode_semantics(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions by the offline client of every part, each in a file of its own."""
    nodes = table(spark, d, "part").selectExpr("p_partkey AS node_id", "p_partkey AS node_seq", "replace(p_name, ' ', '_') AS name", "concat('src/p', p_partkey, '.rs') AS path")
    found = enrich.encode_semantics(nodes, nodes.select("path", F.concat(F.lit("Describe\n"), "name").alias("prompt")))
    return found.select("node_id", F.get("features", F.lit(0)).alias("feature"), "description")


# Two versions of the canonical graph, the second as a patch of the first


NEWER = "n AS (SELECT node_id, CASE WHEN category = 'type' THEN upper(name) ELSE name END AS name FROM nodes WHERE NOT (category = 'function' AND node_id % 5 = 0)), e AS (SELECT * FROM edges WHERE edge_type <> 'extends' AND src IN (SELECT node_id FROM n) AND dst IN (SELECT node_id FROM n))"


def _stored(spark: SparkSession, d: str) -> store.Store:
    """A store whose base is the canonical graph and whose patch takes functions and bases, renames types and adds a call."""
    made = store.Store(spark, scratch.scratch_path(spark, "store"), store.Threshold(patches=1))
    made.save_base(graph(spark, d))
    old = made.load_base()  # made once
    nodes = old.nodes.where("NOT (category = 'function' AND node_id % 5 = 0)").withColumn("name", F.when(F.col("category") == "type", F.upper("name")).otherwise(F.col("name")))
    kept = store.with_both_ends(old.edges.where("edge_type <> 'extends'"), nodes)
    fresh = old.nodes.where("category = 'type'").select((F.col("node_id") + 10**15).alias("edge_seq"), F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit("calls").alias("edge_type"), F.lit(None).cast("map<string,string>").alias("metadata"))
    made.write_patch(store.changes_between(old, store.CodeGraph(nodes, kept.unionByName(fresh))))
    return made


on_stored = f"SELECT 'node' AS kind, name AS label, count(*) AS n FROM n GROUP BY name UNION ALL SELECT 'edge', edge_type, count(*) FROM (SELECT edge_type FROM e UNION ALL SELECT 'calls' FROM nodes WHERE category = 'type') GROUP BY edge_type"


def _labels(g: store.CodeGraph) -> DataFrame:
    return g.nodes.groupBy(F.lit("node").alias("kind"), F.col("name").alias("label")).agg(F.count("*").alias("n")).unionAll(g.edges.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("label")).agg(F.count("*").alias("n")))


@register("store_patch", f"{GRAPH}, {NEWER} {on_stored}")
def store_patch(spark: SparkSession, d: str) -> DataFrame:
    return _labels(_stored(spark, d).load())


@register("store_compact", f"{GRAPH}, {NEWER} {on_stored}")
def store_compact(spark: SparkSession, d: str) -> DataFrame:
    made = _stored(spark, d)
    assert made.should_compact()
    made.compact()
    return _labels(made.load_base())


# Calls of programs of several lines, with the shapes that are not calls among them


CALLS: dict[str, tuple[str, list[tuple[str, str, str]]]] = {
    "rust": ("pub(crate) fn go(s: &S) {\n    let Some(x) = find_%s(s) else { return };\n    match x { A(y) => s.a().%s(y), _ => T::make_%s() }\n    note!(hidden_%s(1));\n}", [("go", "find_%s", "direct"), ("go", "a", "method"), ("go", "%s", "method"), ("go", "T::make_%s", "associated"), ("go", "note", "macro")]),
    "python": ("import os\n\ndef go(x):\n    # hidden_%s()\n    return os.a(x).%s(find_%s('hidden()'))\n", [("go", "a", "method"), ("go", "%s", "method"), ("go", "find_%s", "direct")]),
    "go": ("package main\n\nimport (\n\t\"fmt\"\n)\n\ntype I interface {\n\tHidden_%s() error\n}\n\nfunc go_(x T) {\n\tfmt.Print_%s([]byte(x.find_%s()))\n}", [("go_", "fmt.Print_%s", "constructor"), ("go_", "find_%s", "method")]),
    "c": ("#define M(a) hidden_%s(a)\nint proto_%s(int a);\n\nstatic int\ngo(int a)\n{\n    if (a) return match(find_%s(a));\n    return sizeof(int);\n}", [("go", "match", "direct"), ("go", "find_%s", "direct")]),
    "cpp": ("class A {\n  A(int a);\n  int go();\n};\nint A::go() {\n  W w(find_%s(1));\n  return w.%s() + n::load_%s(2);\n}", [("A::go", "find_%s", "direct"), ("A::go", "%s", "method"), ("A::go", "load_%s", "method")]),
    "javascript": ("const go = async (x) => {\n  await (x);\n  return x.map(async (y) => find_%s(y)).%s(when(1));\n};", [("go", "map", "method"), ("go", "find_%s", "direct"), ("go", "%s", "method"), ("go", "when", "direct")]),
    "typescript": ("interface I { hidden_%s(a: number): void; }\n\nconst go = async (x: I): Promise<number> => find_%s<number>(x.%s());", [("go", "find_%s", "direct"), ("go", "%s", "method")]),
    "java": ("class A {\n    @Hidden(\"x\")\n    int go(int a) {\n        when(a).%s(match(2));\n        return new B(find_%s()).get();\n    }\n}", [("go", "when", "direct"), ("go", "%s", "method"), ("go", "match", "direct"), ("go", "find_%s", "direct"), ("go", "get", "method")]),
    "ruby": ("class A\n  def go(x)\n    x.%s\n    x.a(1).find_%s\n    notify x\n    puts x\n  end\nend", [("go", "%s", "method"), ("go", "a", "method"), ("go", "find_%s", "method"), ("go", "notify", "direct")]),
    "lua": ("function M.go(x)\n  print(x)\n  return x:%s(find_%s(1)), M.b(2)\nend", [("M.go", "%s", "method"), ("M.go", "find_%s", "direct"), ("M.go", "b", "method")]),
    "swift": ("func go(_ x: Int) -> Int {\n    guard let y = find_%s(x) else { return 0 }\n    return y.a(1).%s()\n}", [("go", "find_%s", "direct"), ("go", "a", "method"), ("go", "%s", "method")]),
    "haskell": ("data A = A Int\n  deriving (Show, Eq)\n\ngo :: Int -> Int\ngo x = find_%s (load_%s x)\n", [("go", "find_%s", "direct"), ("go", "load_%s", "direct")]),
    "csharp": ("class A {\n    [Hidden(\"x\")]\n    public int Go(int a) {\n        W w = Find_%s(a);\n        return w.A().B_%s();\n    }\n}", [("Go", "Find_%s", "method"), ("Go", "A", "method"), ("Go", "B_%s", "method")]),
    "scala": ("object A {\n  def go(x: Int): Int = {\n    find_%s[Int](x).b_%s()\n  }\n}", [("go", "find_%s", "method"), ("go", "b_%s", "method")]),
}


def _called(spark: SparkSession, d: str, language: str, program: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    files = table(spark, d, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path"), F.lit(language).alias("language"), F.replace(F.lit(program), F.lit("%s"), name).alias("content"))
    return facts.explode(facts.parse_files(files), "calls").select("path", "caller", "callee", "call_kind")


for _language, (_program, _calls) in CALLS.items():
    _rows = ", ".join(f"('{a}', '{b}', '{k}')" for a, b, k in _calls)
    register(f"calls_{_language}", f"SELECT 'p/' || p_partkey AS path, caller, replace(callee, '%s', replace(p_name, ' ', '_')) AS callee, call_kind FROM part, (VALUES {_rows}) AS v(caller, callee, call_kind)")(lambda spark, d, language=_language, program=_program: _called(spark, d, language, program))
