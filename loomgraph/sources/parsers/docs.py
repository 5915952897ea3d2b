"""Documentation comments: their styles by language, and their text without its marks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Style:
    """``block`` opens a comment that documents, ``line`` begins lines that do, ``other`` lines that end the search."""

    block: tuple[str, ...] = ()
    line: tuple[str, ...] = ()
    other: tuple[str, ...] = ()
    inside: bool = False


_SLASHES = Style(("/**",), ("///",), ("//",))
STYLES = {
    "rust": Style(("/**",), ("///", "//!"), ("//",)),
    "python": Style((), (), ("#",), True),
    "go": Style(("/*",), ("//",), ()),
    "c": Style(("/**", "/*!"), ("///", "//!"), ("//",)),
    "cpp": Style(("/**", "/*!"), ("///", "//!"), ("//",)),
    "javascript": _SLASHES,
    "typescript": _SLASHES,
    "java": _SLASHES,
    "scala": _SLASHES,
    "swift": _SLASHES,
    "csharp": _SLASHES,
    "ruby": Style((), ("#",), ()),
    "lua": Style(("--[[",), ("---", "--"), ()),
    "haskell": Style(("{-|",), ("-- |", "-- ^", "--"), ()),
}

_OPEN, _CLOSE = r"^\s*(?:/\*[*!]?|\{-\|?|--\[\[)", r"(?:\*/|-\}|\]\])\s*$"


def clean_block(comment: Column) -> Column:
    """A block comment without delimiters and leading stars; blank lines and lines of tags (``@param``) go."""
    bare = F.regexp_replace(F.regexp_replace(comment, _OPEN, ""), _CLOSE, "")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*+", "")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("@")), "\n")


def clean(comment: str) -> str:
    """The same for one comment in Python."""
    bare = re.sub(_CLOSE, "", re.sub(_OPEN, "", comment))
    lines = [re.sub(r"^\*+", "", x.strip()).strip() for x in bare.split("\n")]
    return "\n".join(x for x in lines if x and not x.startswith("@"))


def before(lines: list[str], at: int, language: str) -> str | None:
    """The documentation that ends on the line before ``at`` (from 0): a block comment, or lines that document.

    Attributes and decorators may stand between.
    """
    style = STYLES.get(language)
    if style is None:
        return None
    out: list[str] = []
    i = at - 1
    while i >= 0:
        text = lines[i].strip()
        if not out and (text.startswith(("#[", "@", "[")) and not text.startswith("[[")):
            i -= 1
            continue
        mark = next((m for m in style.line if text.startswith(m)), None)
        if mark:
            out.insert(0, text[len(mark) :].strip())
            i -= 1
            continue
        if not out and style.block and re.search(_CLOSE, text):
            end = i
            while i >= 0 and not lines[i].strip().startswith(style.block):
                if lines[i].strip().startswith("/*") and i < end:
                    return None
                i -= 1
            return clean("\n".join(lines[i : end + 1])) if i >= 0 else None
        break
    return "\n".join(x for x in out if x) or None


def inside(lines: list[str], at: int) -> str | None:
    """A triple-quoted text that begins on line ``at``, the first of a body."""
    while at < len(lines) and not lines[at].strip():
        at += 1
    m = re.match(r"\s*[rRuU]?(\"\"\"|''')", lines[at]) if at < len(lines) else None
    if not m:
        return None
    rest = lines[at][m.end() :]
    out = []
    while m[1] not in rest:
        out.append(rest.strip())
        at += 1
        if at >= len(lines):
            return None
        rest = lines[at]
    out.append(rest[: rest.index(m[1])].strip())
    return "\n".join(x for x in out if x)
