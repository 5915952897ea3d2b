"""Snapshots: a graph with what is needed to tell later what has changed.

A snapshot is a folder of tables: ``meta`` (one row), ``nodes``, ``edges``, ``file_hashes``, ``units`` and ``reverse_deps``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import CodeGraph
from loomgraph.operators import diff, report

VERSION = 1
TABLES = ("meta", "nodes", "edges", "file_hashes", "units", "reverse_deps")


@dataclass(frozen=True)
class Snapshot:
    meta: DataFrame
    nodes: DataFrame
    edges: DataFrame
    file_hashes: DataFrame
    units: DataFrame
    reverse_deps: DataFrame

    @property
    def graph(self) -> CodeGraph:
        return CodeGraph(self.nodes, self.edges)

    def stats(self) -> DataFrame:
        """One row: (nodes, edges, files, units, dependents)."""
        n = lambda df, name: df.agg(F.count("*").alias(name))
        return n(self.nodes, "nodes").crossJoin(n(self.edges, "edges")).crossJoin(n(self.file_hashes, "files")).crossJoin(n(self.units, "units")).crossJoin(self.reverse_deps.agg(F.coalesce(F.sum(F.size("dependents")), F.lit(0)).cast("bigint").alias("dependents")))

    def save(self, folder: str) -> None:
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")


def take(graph: CodeGraph, files: DataFrame, repository: str, normalise: bool = True) -> Snapshot:
    """The snapshot of a graph and its files (path, content); hashes are kept of files that are nodes, units of all their definitions."""
    known = graph.nodes.where("category = 'file'").select("path")
    here = files.join(known, "path", "left_semi")
    definitions = graph.nodes.where("location IS NOT NULL AND category <> 'import'").select("path", "name", "kind", "location", "node_id")
    units = diff.units(definitions, here, normalise)
    meta = graph.nodes.sparkSession.range(1).select(F.lit(VERSION).alias("version"), F.lit(repository).alias("repository"), F.unix_timestamp().alias("created_at"), F.unix_timestamp().alias("updated_at"))
    return Snapshot(meta, graph.nodes, graph.edges, diff.file_hashes(here), units, report.reverse_dependencies(graph))


def load(spark: SparkSession, folder: str) -> Snapshot:
    """Read a snapshot; one of another version is an error."""
    out = Snapshot(*(spark.read.parquet(f"{folder}/{name}") for name in TABLES))
    version = out.meta.first()["version"]
    if version != VERSION:
        raise ValueError(f"snapshot version {version} is not {VERSION}")
    return out


def changes(old: Snapshot, files: DataFrame, new_units: DataFrame) -> DataFrame:
    """(path, change) from a snapshot to files (path, content); a modified file none of whose units changed is not listed."""
    every = diff.file_diff(old.file_hashes, diff.file_hashes(files))
    touched = diff.modified_files(every, diff.match_units(old.units, new_units))
    return every.where("change <> 'modified'").unionAll(touched)
