"""Names in other spellings, and feature paths made of file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _words(text: Column, separator: str) -> Column:
    each = F.transform(F.split(text, "[_/-]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    return F.array_join(each, separator)


def pascal_case(text: Column) -> Column:
    """``user_name`` to ``UserName``; words end at underscores, hyphens and slashes."""
    return _words(text, "")


def title_case(text: Column) -> Column:
    return _words(text, " ")


def organize_by_path(path: Column, entity: Column) -> tuple[Column, Column]:
    """(feature_path, functional_area) of an entity by the first three parts of its file's path."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(?<=[^/])\.[^./]*$", "")
    parts = F.split(F.regexp_replace(F.regexp_replace(bare, r"^(\./)+", ""), "^(src/)+", ""), "/")
    part = lambda i, default: pascal_case(F.coalesce(F.get(parts, F.lit(i)), F.lit(default)))
    area = part(0, "core")
    return F.concat_ws("/", area, part(1, "general"), part(2, "misc"), entity), area
