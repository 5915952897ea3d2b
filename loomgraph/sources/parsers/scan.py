"""Reading source text without a grammar: masking of strings and comments, matching of blocks."""

from __future__ import annotations

import bisect
import functools
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Lexical:
    """How a language writes what is not code."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: tuple[str, ...] = ('"', "'")
    char_quote: bool = False  # a single quote may also begin a lifetime or a type variable


@functools.cache
def _openers(lex: Lexical) -> re.Pattern:
    """What begins a comment or a string."""
    marks = [*(o for o, _ in lex.block), *lex.line, *lex.quotes]
    return re.compile("|".join(re.escape(m) for m in marks))


@functools.cache
def _enders(quote: str) -> re.Pattern:
    """What ends a string, or escapes what follows; short ones but those in backticks end with their line."""
    return re.compile(re.escape(quote) + r"|\\" + (r"|\n" if len(quote) == 1 and quote != "`" else ""))


_CHARACTER = re.compile(r"'(\\.[^']*|[^'\\\n])'")
_NOT_BREAK = re.compile(r"[^\n]")


def mask(source: str, lex: Lexical) -> tuple[str, str]:
    """(code, code with strings): comments, and in the first strings too, become spaces; line breaks stay."""
    out, kept = [], []
    i, n, done = 0, len(source), 0

    def blank(a: int, b: int, comment: bool) -> None:
        nonlocal done
        spaces = _NOT_BREAK.sub(" ", source[a:b])
        out.extend((source[done:a], spaces))
        kept.extend((source[done:a], spaces) if comment else (source[done:b],))
        done = min(b, n)

    openers = _openers(lex)
    while opener := openers.search(source, i):
        i = opener.start()
        opened = next(((o, c) for o, c in lex.block if source.startswith(o, i)), None)
        if opened:
            end = source.find(opened[1], i + len(opened[0]))
            end = n if end < 0 else end + len(opened[1])
            blank(i, end, True)
        elif source.startswith(lex.line, i):
            end = source.find("\n", i)
            end = n if end < 0 else end
            blank(i, end, True)
        else:
            quote = source[i]
            if quote == "'" and lex.char_quote and not _CHARACTER.match(source[i : i + 12]):
                i += 1
                continue
            long = source[i : i + 3] if source[i : i + 3] == quote * 3 else quote
            end, enders = i + len(long), _enders(long)
            while (m := enders.search(source, end)) and m[0] == "\\":
                end = m.start() + 2
            end = m.start() if m else n
            blank(i + len(long), end, False)
            end += len(long)
        i = end
    rest = source[done:]
    return "".join((*out, rest)), "".join((*kept, rest))


class Places:
    """Lines and columns, from 1, of offsets."""

    def __init__(self, source: str):
        self.starts = [0, *[m.end() for m in re.finditer("\n", source)]]

    def line(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)

    def at(self, offset: int) -> tuple[int, int]:
        line = self.line(offset)
        return line, offset - self.starts[line - 1] + 1


_PAIRS = {o: (o, re.compile(re.escape(o) + "|" + re.escape(c))) for o, c in ("()", "[]", "{}")}
_ENDS = re.compile(r"[({;\[\])]|\n[ \t]*\n|=>?")


def close(code: str, at: int) -> int:
    """The offset after the bracket that closes the one at ``at``; the end of the text if none does."""
    (opener, either), depth = _PAIRS[code[at]], 0
    for m in either.finditer(code, at):
        depth += 1 if m[0] == opener else -1
        if depth == 0:
            return m.end()
    return len(code)


def brace_end(code: str, at: int) -> int:
    """Where a declaration that begins at ``at`` ends: with its block, or at a semicolon or blank line before one."""
    depth = 0
    for m in _ENDS.finditer(code, at):
        if m[0] in "([":
            depth += 1
        elif m[0] in ")]":
            depth -= 1
        elif depth <= 0:
            if m[0] == "{":
                return close(code, m.start())
            if m[0] == ";" or m[0].startswith("\n"):
                return m.start() + (m[0] == ";")
    return len(code)


def keyword_end(code: str, at: int, opens: str) -> int:
    """Where a block of words ends with ``end``."""
    depth = 0
    for m in re.compile(rf"\b(?:{opens})\b|\bend\b").finditer(code, at):
        depth += -1 if m[0] == "end" else 1
        if depth <= 0:
            return m.end()
    return len(code)


def indent_end(code: str, at: int) -> int:
    """Where the lines end that are indented more than the one at ``at``."""
    start = code.rfind("\n", 0, at) + 1
    depth = len(re.match(r"[ \t]*", code[start:])[0])
    end = code.find("\n", at)
    while 0 <= end < len(code):
        after = code.find("\n", end + 1)
        text = code[end + 1 : after if after >= 0 else len(code)]
        if text.strip() and len(re.match(r"[ \t]*", text)[0]) <= depth:
            return end
        if after < 0:
            return len(code)
        end = after
    return len(code)
