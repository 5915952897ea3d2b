"""The property graph's tables, and the values that their columns may have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORIES = ("repository", "directory", "file", "module", "type", "function", "variable", "import", "constant", "field", "parameter", "feature", "component", "functional_centroid")
LEVELS = ("low", "intermediate", "high")
FUNCTIONAL = ("belongs_to_feature", "implements_feature", "contains_feature")
DEPENDENCY = ("contains", "imports", "calls", "extends", "implements", "references", "depends_on", "ffi_binding", "defines", "uses", "uses_type", "belongs_to_component")
EDGE_TYPES = (*DEPENDENCY, *FUNCTIONAL)
CALL_KINDS = ("direct", "method", "associated", "constructor", "macro")
UNIT_KINDS = ("function", "struct", "enum", "trait", "impl", "module")

LOCATION = "struct<file:string,start_line:int,start_column:int,end_line:int,end_column:int>"
#: ``node_seq`` and ``edge_seq`` keep insertion order, by which first and last matches are told.
NODES = (
    "node_id bigint, node_seq bigint, category string, kind string, language string, name string, path string, "
    f"location {LOCATION}, metadata map<string,string>, description string, features array<string>, feature_path string, signature string, "
    "source_ref struct<start_line:int,end_line:int>, semantic_feature string, node_level string, documentation string"
)
EDGES = "edge_seq bigint, src bigint, dst bigint, edge_type string, metadata map<string,string>"

_KINDS = {"fn": "function", "mod": "module", "module": "module", "const": "constant", "constant": "constant"} | dict.fromkeys(("struct", "enum", "trait", "type", "class", "interface"), "type")


def category_of_kind(kind: Column) -> Column:
    """The node category of a definition's kind; whatever is not listed is a variable."""
    pairs = [F.lit(x) for pair in _KINDS.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[kind], F.lit("variable"))


def edge_view(edge_type: Column) -> Column:
    """Functional or dependency; containment counts as dependency."""
    return F.when(edge_type.isin(*FUNCTIONAL), "functional").otherwise("dependency")


def parse_category(text: Column) -> Column:
    """A stored category; an unknown one is a function."""
    return F.when(F.lower(text).isin(*CATEGORIES), F.lower(text)).otherwise("function")


def parse_edge_type(text: Column) -> Column:
    """A stored edge type; an unknown one is a reference."""
    return F.when(F.lower(text).isin(*EDGE_TYPES), F.lower(text)).otherwise("references")
