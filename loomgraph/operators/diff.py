"""Differences of two states of a source tree, by content hash: of files, and of the units within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.link import occurrence
from loomgraph.schema import UNIT_KINDS

#: Kinds under which languages name a function; they count as units if names are normalised.
FUNCTION_KINDS = ("fn", "func", "def", "method", "function")


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, in lower-case hexadecimal."""
    return F.sha2(text, 256)


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, hash) of (path, content)."""
    return files.select("path", content_hash(F.col("content")).alias("hash"))


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of (path, hash) on both sides: added, deleted or modified; unchanged files have no row."""
    o, n = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def diff_stats(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def unit_type(kind: Column, normalise: bool = True) -> Column:
    """The unit type of a definition kind, null if it is no unit; ``normalise`` counts all names of functions as one."""
    named = F.when(kind.isin(*FUNCTION_KINDS), "function").otherwise(kind) if normalise else kind
    return F.when(named.isin(*UNIT_KINDS), named)


def units(definitions: DataFrame, files: DataFrame, normalise: bool = True) -> DataFrame:
    """(path, name, unit_type, start_line, end_line, hash): the lines of each definition that is a unit, hashed."""
    marked = definitions.withColumn("unit_type", unit_type(F.col("kind"), normalise)).where("unit_type IS NOT NULL")
    joined = marked.join(files.select("path", F.split("content", "\n").alias("_lines")), "path")
    start, end = F.col("location.start_line"), F.col("location.end_line")
    own = F.array_join(F.slice("_lines", start, F.greatest(end - start + 1, F.lit(0))), "\n")
    return joined.select("path", "name", "unit_type", start.alias("start_line"), end.alias("end_line"), content_hash(own).alias("hash"))


def match_units(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, name, unit_type, nth, change) of units (path, name, unit_type, start_line, hash).

    The k-th unit of a name and type in a file pairs with the k-th of the other side; pairs are unchanged or changed,
    units without a partner added or deleted.
    """
    by = ["path", "name", "unit_type"]
    side = lambda df, name: df.select(*by, occurrence(by, ["start_line"]).alias("nth"), F.col("hash").alias(name))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("unchanged")
    return side(old, "old_hash").join(side(new, "new_hash"), [*by, "nth"], "full_outer").select(*by, "nth", change.alias("change"))


def modified_files(changes: DataFrame, unit_changes: DataFrame) -> DataFrame:
    """The modified files in which some unit changed; a file that only differs outside its units is not reported."""
    touched = unit_changes.where("change <> 'unchanged'").select("path").distinct()
    return changes.where("change = 'modified'").join(touched, "path", "left_semi")


def node_index(cached: DataFrame) -> DataFrame:
    """(node_id, path, ordinal) of (path, units): where each node's unit is cached."""
    return cached.select("path", F.posexplode("units").alias("ordinal", "unit")).where("unit.node_id IS NOT NULL").select("unit.node_id", "path", "ordinal")


def directory_hash(files: DataFrame, value: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, hash): SHA-256 over the lines "path|value" of all files in order of path; the value is the content's hash unless given.

    Paths and hashes of one directory (or of everything, without ``by``) meet in one task, contents never do.
    """
    value = content_hash(F.col("content")) if value is None else value
    lines = files.select(*(by or []), F.struct("path", value.cast("string").alias("v")).alias("e"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: F.concat(e["path"], F.lit("|"), e["v"], F.lit("\n"))), "")
    return lines.groupBy(*(by or [])).agg(F.sha2(text, 256).alias("hash"))
