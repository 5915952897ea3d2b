"""A property graph made of star-schema tables, and facts to link, in DataFrame form and as SQL of the same meaning.

Regions contain nations, these contain customers, which stand for files; parts are the definitions in them, suppliers
the centroids that parts belong to; an order line is a call of its customer's file to its part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.graph import CodeGraph

SPAN = 10**13  # edge_seq: the type's ordinal times this, plus a number within the type
TYPES = ("contains", "calls", "imports", "depends_on", "belongs_to_feature", "extends")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _size(df: DataFrame, name: str) -> DataFrame:
    return F.broadcast(df.agg(F.count("*").alias(name)))  # one row


def _name(p: str = "") -> str:
    return f"concat(replace({p}p_name, ' ', '_'), '_', cast({p}p_size AS string))"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    region, nation = t("region"), t("nation")
    placed = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # the nations of the world
    part = t("part")
    feature = part.select(F.col("p_partkey").alias("_key"), F.lower("p_name").alias("semantic_feature"))
    null = "cast(NULL AS string)"
    parts = [
        region.selectExpr("cast(r_regionkey AS bigint) AS node_id", "'repository' AS category", "'repository' AS kind", "'unknown' AS language", "r_name AS name", "r_name AS path", f"{null} AS description", "'low' AS node_level", f"{null} AS semantic_feature"),
        placed.selectExpr("cast(100 + n_nationkey AS bigint) AS node_id", "'directory' AS category", "'directory' AS kind", "'unknown' AS language", "n_name AS name", "concat(r_name, '/', n_name) AS path", f"{null} AS description", "'low' AS node_level", f"{null} AS semantic_feature"),
        t("supplier").join(feature, F.col("s_suppkey") == F.col("_key"), "left").selectExpr("1000000 + s_suppkey AS node_id", "'component' AS category", "'component' AS kind", "'unknown' AS language", "s_name AS name", f"{null} AS path", f"{null} AS description", "'high' AS node_level", "semantic_feature"),
        t("customer").join(F.broadcast(placed), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("2000000 + c_custkey AS node_id", "'file' AS category", "'file' AS kind", "lower(c_mktsegment) AS language", "c_name AS name", "concat(r_name, '/', n_name, '/', c_name) AS path", f"{null} AS description", "'low' AS node_level", f"{null} AS semantic_feature"),
        part.selectExpr("3000000 + p_partkey AS node_id", "CASE WHEN p_partkey % 3 = 0 THEN 'type' ELSE 'function' END AS category", "CASE WHEN p_partkey % 3 = 0 THEN 'struct' ELSE 'fn' END AS kind", "'rust' AS language", f"{_name()} AS name", f"{null} AS path", "concat(p_name, ' ', lower(p_type)) AS description", "'low' AS node_level", "lower(concat(p_name, ' ', p_type)) AS semantic_feature"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("node_seq", F.col("node_id"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their customer and ``n``, which numbers the lines of an order."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    numbered = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus", F.row_number().over(by).alias("n"))
    return numbered.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    part = t("part").select("p_partkey")
    counted = part.crossJoin(_size(t("part"), "parts")).crossJoin(_size(t("customer"), "files")).crossJoin(_size(t("supplier"), "centroids"))
    called = lines(spark, sf_dir)

    def of(df: DataFrame, edge_type: str, seq: str, src: str, dst: str, kind: str = "cast(NULL AS map<string,string>)") -> DataFrame:
        base = (TYPES.index(edge_type) + 1) * SPAN
        return df.selectExpr(f"cast({base} + {seq} AS bigint) AS edge_seq", f"cast({src} AS bigint) AS src", f"cast({dst} AS bigint) AS dst", f"'{edge_type}' AS edge_type", f"{kind} AS metadata")

    call = "2000000 + o_custkey", "3000000 + l_partkey"
    parts = [
        of(t("nation"), "contains", "100 + n_nationkey", "n_regionkey", "100 + n_nationkey"),
        of(t("customer"), "contains", "2000000 + c_custkey", "100 + c_nationkey", "2000000 + c_custkey"),
        of(counted, "contains", "3000000 + p_partkey", "2000000 + p_partkey % files", "3000000 + p_partkey"),
        of(called, "calls", "l_orderkey * 1000 + n", *call, "map('call_kind', CASE l_returnflag WHEN 'A' THEN 'method' WHEN 'R' THEN 'associated' ELSE 'direct' END)"),
        of(called.where("l_linenumber = 1"), "imports", "l_orderkey * 1000 + n", *call),
        of(counted, "depends_on", "p_partkey", "3000000 + p_partkey", "3000000 + (7 * p_partkey + 1) % parts"),
        of(counted, "belongs_to_feature", "p_partkey", "3000000 + p_partkey", "1000000 + p_partkey % centroids"),
        of(counted.where("p_partkey % 3 = 0 AND (p_partkey + 3) % parts % 3 = 0"), "extends", "p_partkey", "3000000 + p_partkey", "3000000 + (p_partkey + 3) % parts"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    return CodeGraph(nodes(spark, sf_dir), edges(spark, sf_dir))


# Facts to link: calls, imports and type references of files, and the definitions in them


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, name, node_id, node_seq, kind): file numbers are paths."""
    files = _size(table(spark, sf_dir, "customer"), "files")
    return table(spark, sf_dir, "part").crossJoin(files).selectExpr("cast(p_partkey % files AS string) AS path", f"{_name()} AS name", "3000000 + p_partkey AS node_id", "p_partkey AS node_seq", "CASE WHEN p_partkey % 3 = 0 THEN 'struct' ELSE 'fn' END AS kind")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("cast(c_custkey AS string) AS path", "2000000 + c_custkey AS node_id")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, callee, receiver, seq): lines with a returned part have its type's name as receiver."""
    called = lines(spark, sf_dir).join(table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_name()} AS name"), F.col("l_partkey") == F.col("p_partkey"))
    return called.selectExpr("cast(o_custkey AS string) AS path", "name AS callee", "CASE WHEN l_returnflag = 'R' THEN name END AS receiver", "l_orderkey * 1000 + n AS seq", "l_linestatus")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, module_path, imported_names, node_id, seq): one for each first line of an order."""
    called = lines(spark, sf_dir).where("l_linenumber = 1").join(table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_name()} AS name"), F.col("l_partkey") == F.col("p_partkey"))
    return called.selectExpr("cast(o_custkey AS string) AS path", "concat('crate::', name) AS module_path", "cast(NULL AS array<string>) AS imported_names", "4000000 + l_orderkey * 1000 + n AS node_id", "l_orderkey * 1000 + n AS seq")


LINES_SQL = """line AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag, l_linestatus, o_custkey, n FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_returnflag, l_linestatus) AS n FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey)"""
NODES_SQL = """nodes AS (SELECT *, node_id AS node_seq FROM (
  SELECT CAST(r_regionkey AS BIGINT) AS node_id, 'repository' AS category, 'repository' AS kind, 'unknown' AS language, r_name AS name, r_name AS path, NULL AS description, 'low' AS node_level, NULL AS semantic_feature FROM region
  UNION ALL SELECT 100 + n_nationkey, 'directory', 'directory', 'unknown', n_name, r_name || '/' || n_name, NULL, 'low', NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 1000000 + s_suppkey, 'component', 'component', 'unknown', s_name, NULL, NULL, 'high', lower(p_name) FROM supplier LEFT JOIN part ON p_partkey = s_suppkey
  UNION ALL SELECT 2000000 + c_custkey, 'file', 'file', lower(c_mktsegment), c_name, r_name || '/' || n_name || '/' || c_name, NULL, 'low', NULL FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 3000000 + p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'type' ELSE 'function' END, CASE WHEN p_partkey % 3 = 0 THEN 'struct' ELSE 'fn' END, 'rust',
    replace(p_name, ' ', '_') || '_' || p_size, NULL, p_name || ' ' || lower(p_type), 'low', lower(p_name || ' ' || p_type) FROM part))"""
EDGES_SQL = f"""{LINES_SQL},
edges AS (
  SELECT {SPAN} + 100 + n_nationkey AS edge_seq, CAST(n_regionkey AS BIGINT) AS src, CAST(100 + n_nationkey AS BIGINT) AS dst, 'contains' AS edge_type FROM nation
  UNION ALL SELECT {SPAN} + 2000000 + c_custkey, 100 + c_nationkey, 2000000 + c_custkey, 'contains' FROM customer
  UNION ALL SELECT {SPAN} + 3000000 + p_partkey, 2000000 + p_partkey % (SELECT count(*) FROM customer), 3000000 + p_partkey, 'contains' FROM part
  UNION ALL SELECT {2 * SPAN} + l_orderkey * 1000 + n, 2000000 + o_custkey, 3000000 + l_partkey, 'calls' FROM line
  UNION ALL SELECT {3 * SPAN} + l_orderkey * 1000 + n, 2000000 + o_custkey, 3000000 + l_partkey, 'imports' FROM line WHERE l_linenumber = 1
  UNION ALL SELECT {4 * SPAN} + p_partkey, 3000000 + p_partkey, 3000000 + (7 * p_partkey + 1) % (SELECT count(*) FROM part), 'depends_on' FROM part
  UNION ALL SELECT {5 * SPAN} + p_partkey, 3000000 + p_partkey, 1000000 + p_partkey % (SELECT count(*) FROM supplier), 'belongs_to_feature' FROM part
  UNION ALL SELECT {6 * SPAN} + p_partkey, 3000000 + p_partkey, 3000000 + (p_partkey + 3) % (SELECT count(*) FROM part), 'extends' FROM part WHERE p_partkey % 3 = 0 AND (p_partkey + 3) % (SELECT count(*) FROM part) % 3 = 0)"""
FACTS_SQL = f"""{LINES_SQL},
def AS (SELECT CAST(p_partkey % (SELECT count(*) FROM customer) AS VARCHAR) AS path, replace(p_name, ' ', '_') || '_' || p_size AS name, 3000000 + p_partkey AS node_id, p_partkey AS node_seq, CASE WHEN p_partkey % 3 = 0 THEN 'struct' ELSE 'fn' END AS kind FROM part),
called AS (SELECT CAST(o_custkey AS VARCHAR) AS path, name, CASE WHEN l_returnflag = 'R' THEN name END AS receiver, l_orderkey * 1000 + n AS seq, l_linenumber, l_linestatus FROM line JOIN def ON 3000000 + l_partkey = node_id),
imp AS (SELECT path, 'crate::' || name AS module_path, name, 4000000 + seq AS node_id, seq FROM called WHERE l_linenumber = 1),
qual AS (SELECT path, name, max_by(node_id, node_seq) AS node_id FROM def GROUP BY ALL),
bare AS (SELECT name, min_by(node_id, node_seq) AS node_id, count(*) AS many FROM def GROUP BY ALL),
brought AS (SELECT DISTINCT path, name FROM imp)"""
