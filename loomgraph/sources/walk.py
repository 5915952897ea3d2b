"""Source files of a tree: walking, ignore rules, languages, reading."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans import scratch

#: Extensions of each language, in the order of registration; of two languages with one extension the later wins.
EXTENSIONS = {
    "rust": ("rs",),
    "python": ("py", "pyi"),
    "go": ("go",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx", "h"),
    "javascript": ("js", "mjs", "cjs"),
    "typescript": ("ts", "tsx"),
    "java": ("java",),
    "ruby": ("rb", "rake"),
    "lua": ("lua",),
    "swift": ("swift",),
    "haskell": ("hs", "lhs"),
    "csharp": ("cs",),
    "scala": ("scala", "sc"),
}
LANGUAGE_OF = {e: language for language, extensions in EXTENSIONS.items() for e in extensions}
IGNORE_FILES = (".gitignore", ".ignore")
OWN_IGNORE_FILE = ".loomignore"
EXCLUDES = ".git/info/exclude"


def languages() -> list[str]:
    return list(EXTENSIONS)


def extension(path: Column) -> Column:
    """What follows the last dot of a file's name, null if there is none; upper case counts."""
    return F.nullif(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1), F.lit(""))


def language_of(path: Column) -> Column:
    """The language that a path's extension is registered for, else null."""
    pairs = [F.lit(x) for pair in LANGUAGE_OF.items() for x in pair]
    return F.create_map(*pairs)[extension(path)]


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def _listed(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _filesystem(root)
        for batch in batches:
            rows = []
            for folder in batch["path"]:
                infos = fs.get_file_info(pa.fs.FileSelector(f"{base}/{folder}".rstrip("/"), recursive=False))
                rows += [(f"{folder}/{i.base_name}".lstrip("/"), i.type == pa.fs.FileType.Directory) for i in infos]
            yield pd.DataFrame(rows, columns=["path", "is_dir"])

    return run


def _contents(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _filesystem(root)

        def read(path: str) -> str | None:
            try:
                with fs.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    return stream.read().decode("utf-8")
            except (OSError, UnicodeDecodeError):
                return None  # reported as a parse error

        for batch in batches:
            yield batch.assign(content=[read(p) for p in batch["path"]])

    return run


def paths(spark: SparkSession, root: str, max_depth: int | None = None) -> DataFrame:
    """(path) of all files under a root, relative to it, hidden ones included; a round of tasks lists a level of folders."""
    folders, found, level = spark.createDataFrame([("",)], "path string"), None, 0
    while True:
        level += 1
        listed = scratch.materialize(folders.mapInPandas(_listed(root.rstrip("/")), "path string, is_dir boolean"), "listing")
        own = listed.where("NOT is_dir").select("path")
        found = own if found is None else found.unionAll(own)
        folders = listed.where("is_dir").select("path")
        if (max_depth is not None and level >= max_depth) or folders.isEmpty():
            return found
        folders = folders.repartition(F.col("path"))


def walk(spark: SparkSession, root: str, max_depth: int | None = None, known_only: bool = True, ignore: bool = True, contents: bool = True, ignore_file: str = OWN_IGNORE_FILE) -> DataFrame:
    """(path, language, content) of the files under a root, paths relative to it; hidden files are included.

    ``ignore`` leaves out what the tree's ignore files name, ``ignore_file`` among them, and its ``.git/info/exclude``; ``known_only`` what no language is registered for. Filters on
    paths run before contents are read; a file that cannot be read has a null content.
    """
    base = root.rstrip("/")
    every = paths(spark, base, max_depth)
    kept = every.withColumn("language", language_of(F.col("path")))
    if known_only:
        kept = kept.where("language IS NOT NULL")
    if ignore:
        named = every.where(F.element_at(F.split("path", "/"), -1).isin(*IGNORE_FILES, ignore_file))
        texts = named.unionAll(spark.createDataFrame([(EXCLUDES,)], "path string")).mapInPandas(_contents(base), "path string, content string").where("content IS NOT NULL")
        # Ignore files are few and small: one a directory at most, of each kind.
        rules = [rule for r in texts.orderBy("path").collect() for rule in parse_rules(r.content, "" if r.path == EXCLUDES else r.path.rpartition("/")[0])]
        if rules:
            kept = kept.mapInPandas(_not_ignored(rules), "path string, language string")
    return kept.mapInPandas(_contents(base), "path string, language string, content string") if contents else kept


def parse_rules(text: str, folder: str) -> list[tuple[str, str, bool, bool]]:
    """(folder, pattern, negated, directories only) of the lines of an ignore file, in order."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:].removeprefix("\\")
        only = line.endswith("/")
        rules.append((folder, line.rstrip("/"), negated, only))
    return rules


def _matches(path: str, is_dir: bool, rule: tuple[str, str, bool, bool]) -> bool:
    folder, pattern, _, only = rule
    if only and not is_dir:
        return False
    if folder:
        if not path.startswith(folder + "/"):
            return False
        path = path[len(folder) + 1 :]
    if "/" not in pattern:
        return fnmatch.fnmatchcase(path.rpartition("/")[2], pattern)
    return re.fullmatch(_glob(pattern.removeprefix("/")), path) is not None


def _glob(pattern: str) -> str:
    """A path pattern as a regular expression: * stays within a component, ** does not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return out


def ignored(path: str, rules: list[tuple[str, str, bool, bool]]) -> bool:
    """Whether rules leave a file out; the last match decides, and nothing comes back from an ignored directory."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        own, out = "/".join(parts[:n]), False
        for rule in rules:
            if _matches(own, n < len(parts), rule):
                out = not rule[2]
        if out:
            return True
    return False


def _not_ignored(rules: list[tuple[str, str, bool, bool]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[not ignored(p, rules) for p in batch["path"]]]

    return run
