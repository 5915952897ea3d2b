"""Token-similarity and substring search over node text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("name", "semantic_feature", "description")


def tokens(text: Column) -> Column:
    """The distinct lower-case tokens of a text, between white space of any kind; names with underscores are one."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets of tokens as a 32-bit number: of two empty ones 1, of one empty one 0."""
    both = F.size(F.array_intersect(a, b))
    score = both / (F.size(a) + F.size(b) - both)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(score).cast("float")


def similarity(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b))


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of the pairs of (a, tokens) and (b, tokens) whose similarity is at least ``least``, above 0.

    Two sets of that similarity share a token among the rarest of either: all but as many of its tokens as could be shared
    without, so only these are joined, and frequent tokens meet where nothing rarer does. What meets is compared whole.
    Sets whose sizes differ too much cannot reach it: those that fit no size of the other side go before that, pairs as they meet.
    """
    bound = least - 1e-6  # a little less, as scores are rounded to 32 bits

    def fitting(side: DataFrame, other: DataFrame) -> DataFrame:
        sizes = other.agg(F.min(F.when(F.size("tokens") > 0, F.size("tokens"))).alias("_least"), F.max(F.size("tokens")).alias("_most"))  # one row
        own = side.withColumn("_size", F.size("tokens")).crossJoin(F.broadcast(sizes))
        return own.where((F.col("_size") >= F.col("_least") * bound) & (F.col("_size") * bound <= F.col("_most"))).drop("_least", "_most", "_size")

    left, right = fitting(left, right), fitting(right, left)
    counts = left.select(F.explode("tokens").alias("token")).unionAll(right.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count("*").alias("n"))

    def rare(side: DataFrame, key: str) -> DataFrame:
        own = side.select(key, F.explode("tokens").alias("token")).join(counts, "token").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("sorted"))
        keep = F.size("sorted") - F.ceil(F.size("sorted") * bound).cast("int") + 1
        return own.select(key, F.size("sorted").alias(f"size_{key}"), F.explode(F.slice("sorted", 1, keep)).alias("x")).select(key, f"size_{key}", F.col("x.token").alias("token"))

    close = (F.col("size_a") >= F.col("size_b") * bound) & (F.col("size_b") >= F.col("size_a") * bound)
    met = rare(left, "a").join(rare(right, "b"), "token").where(close).select("a", "b").distinct()
    whole = met.join(left.select("a", F.col("tokens").alias("ta")), "a").join(right.select("b", F.col("tokens").alias("tb")), "b")
    return whole.select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("score")).where(F.col("score") >= F.lit(least).cast("float"))


def scored(nodes: DataFrame, query: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """The nodes with score and matched_field: the best field, the earlier among equals, "" if none scores."""
    wanted = sorted({t for t in query.lower().split()})
    asked = F.array(*[F.lit(t) for t in wanted]) if wanted else F.array().cast("array<string>")
    each = [(f, F.when(F.col(f).isNull(), F.lit(0.0).cast("float")).otherwise(jaccard(tokens(F.col(f)), asked))) for f in fields if f in nodes.columns]
    if "features" in nodes.columns:
        best = F.array_max(F.transform("features", lambda x: jaccard(tokens(x), asked)))
        each.append(("features", F.coalesce(best, F.lit(0.0).cast("float"))))
    columns = nodes.columns
    named = nodes.select("*", *[c.alias(f"_s{i}") for i, (_, c) in enumerate(each)])
    marks = [F.col(f"_s{i}") for i in range(len(each))]
    score = F.greatest(*marks) if len(marks) > 1 else marks[0]
    field = F.coalesce(*[F.when((m == F.col("score")) & (m > 0), name) for m, (name, _) in zip(marks, each, strict=True)], F.lit(""))
    return named.withColumn("score", score).withColumn("matched_field", field).select(*columns, "score", "matched_field")


def filtered(nodes: DataFrame, categories: Sequence[str] | None = None, level: str | None = None, include_high: bool = True, include_low: bool = True) -> DataFrame:
    """Filters that run before any scoring."""
    if categories:
        nodes = nodes.where(F.col("category").isin(*categories))
    if level:
        nodes = nodes.where(F.col("node_level") == level)
    if not include_high:
        nodes = nodes.where("node_level <> 'high'")
    if not include_low:
        nodes = nodes.where("node_level <> 'low'")
    return nodes


def search(nodes: DataFrame, query: str, limit: int = 10, min_similarity: float = 0.3, **filters) -> DataFrame:
    """(node_id, score, matched_field) of the best nodes, the earlier among equals; an empty query finds nothing."""
    found = scored(filtered(nodes, **filters), query).where(F.col("score") >= F.lit(min_similarity).cast("float"))
    if not query.split():
        found = found.where(F.lit(False))
    return found.orderBy(F.desc("score"), "node_seq").limit(limit).select("node_id", "score", "matched_field")


def by_substring(nodes: DataFrame, query: str, kind: str | None = None, category: str | None = None, limit: int = 50) -> DataFrame:
    """The first nodes whose name has the text in it, whatever its case; an unknown category filters nothing."""
    found = nodes.where(F.contains(F.lower("name"), F.lit(query.lower())))
    if kind:
        found = found.where(F.col("kind") == kind)
    known = SERVICE_CATEGORIES.get((category or "").lower())
    if known:
        found = found.where(F.col("category") == known)
    return found.orderBy("node_seq").limit(limit)


#: The categories that a service caller may name, with other names for two of them.
SERVICE_CATEGORIES = {c: c for c in ("repository", "directory", "file", "module", "type", "function", "variable", "import")} | {"typedef": "type", "fn": "function"}
