"""Facts of one source file: imports, definitions, calls and type references, for fourteen languages.

Python is read with its own grammar; the others with patterns over text without strings and comments, and matched
blocks. Unusual layouts (macros that make definitions, preprocessor branches, operators as names, several declarations on one line)
are not seen. Strings and comments never give facts.
"""

from __future__ import annotations

import ast
import bisect
import functools
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from loomgraph.sources.parsers import docs
from loomgraph.sources.parsers.builtins import is_builtin
from loomgraph.sources.parsers.scan import Lexical, Places, brace_end, close, indent_end, keyword_end, mask

Facts = dict[str, list[dict]]
_ID = r"[A-Za-z_]\w*"


@dataclass(frozen=True)
class Definition:
    """A pattern with a group ``name``; ``kind`` may be a function of the match; ``scope``: its block encloses calls or members."""

    pattern: str
    kind: str | Callable[[re.Match], str | None]
    metadata: Callable[[re.Match], dict] | None = None


@dataclass(frozen=True)
class Language:
    name: str
    lexical: Lexical
    definitions: tuple[Definition, ...]
    imports: Callable[[str, str], list[tuple[int, str, list[str], bool, dict]]]
    calls: str = "plain"  # how calls look: plain, rust, methods (only), none
    separators: str = r"\.|::|->|\?\."
    end: Callable[[str, int], int] = brace_end
    functions: tuple[str, ...] = ("fn", "func", "function", "method", "def")
    types_after: bool = True  # types follow names (name: Type), or come before them
    private: str = r"\bprivate\b|\bprotected\b"

    @property
    def keywords(self) -> frozenset[str]:
        """Words before a bracket that are no call."""
        return KEYWORDS.get(self.name, frozenset())


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_C_WORDS = "if for while switch return sizeof do else case goto defined typeof _Alignof alignof __attribute__ __asm__ asm _Static_assert"
_JS_WORDS = "if for while switch return catch function do else case throw super import typeof delete void await yield in of instanceof async new"
KEYWORDS = {
    "rust": _words("if while for match return loop in let as move else unsafe fn where impl dyn ref mut pub use break Fn FnMut FnOnce"),
    "go": _words("if for switch select return func go defer range case interface struct map chan import const var type else package"),
    "c": _words(_C_WORDS),
    "cpp": _words(_C_WORDS + " catch new delete throw decltype static_assert noexcept co_await co_return co_yield typeid and or not explicit operator template using this"),
    "javascript": _words(_JS_WORDS),
    "typescript": _words(_JS_WORDS),
    "java": _words("if for while switch return catch synchronized do else case throw new super this assert instanceof try"),
    "ruby": _words("if unless while until case when return yield def class module and or not elsif in then do begin rescue ensure defined? alias undef else end self super nil true false redo retry break next"),
    "lua": _words("if while for function return and or not until elseif in local then do end repeat else"),
    "swift": _words("if guard while for switch return func in catch do else case init super self throw try await defer where is as let var subscript deinit some any"),
    "csharp": _words("if for foreach while switch return catch using lock typeof sizeof default checked unchecked fixed new throw await yield base this when is as in out ref stackalloc and or not"),
    "scala": _words("if for while match return catch do else case yield throw new super this def val var with extends import try finally type given using"),
}
#: Calls that the languages' own facts leave out.
NO_CALLS = {"ruby": _words("require require_relative load puts print p"), "lua": _words("require print"), "javascript": _words("require"), "typescript": _words("require")}


def _list(text: str | None) -> list[str]:
    """The names of a comma-separated list, without arguments and bounds."""
    out = []
    for part in re.split(r",(?![^<(\[]*[>)\]])", text or ""):
        name = re.match(rf"\s*(?:public|private|protected|virtual|override|\s)*([\w.:]+)", part)
        if name and name[1].strip(":"):
            out.append(name[1])
    return out


def _meta(**groups: str) -> Callable[[re.Match], dict]:
    """Metadata from groups: a name that ends in s is a list."""

    def make(m: re.Match) -> dict:
        out: dict = {}
        for key, group in groups.items():
            if m[group]:
                out[key] = _list(m[group]) if key.endswith("s") else m[group].strip()
        return out

    return make


def _last(path: str) -> str:
    return re.split(r"[./:\\]+", path.rstrip("/"))[-1]


# Imports: (offset, module path, imported names, glob, metadata)


def _imports_rust(code: str, text: str):
    for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))? +)?use +([^;]+);", code, re.M):
        path = re.sub(r"\s+", " ", m[1]).strip()
        group = re.fullmatch(r"(.*?)(?:::)?\{(.*)\}", path)
        if group:
            names = [x.strip() for x in group[2].split(",") if x.strip()]
            yield m.start(1), "::".join([group[1], *names]) if group[1] else "::".join(names), [] if "*" in path else [names[-1].split("::")[-1]], "*" in path, {}
        else:
            yield m.start(1), path, [] if "*" in path else [path.split("::")[-1]], "*" in path, {}


def _imports_go(code: str, text: str):
    for m in re.finditer(r"^import\s*(?:\(([^)]*)\)|([^\n(]+))", text, re.M):
        body, base = (m[1], m.start(1)) if m[1] is not None else (m[2], m.start(2))
        for s in re.finditer(rf"(?:({_ID}|\.|_)[ \t]+)?\"([^\"]+)\"", body):
            yield base + s.start(), s[2], [f"{s[2]} as {s[1]}" if s[1] else s[2].rsplit("/", 1)[-1]], False, {}


def _imports_c(code: str, text: str):
    for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*([<\"])([^>\"\n]+)[>\"]", text, re.M):
        yield m.start(), m[2], [], False, {"system": m[1] == "<"}


def _imports_js(code: str, text: str):
    for m in re.finditer(r"^[ \t]*import\s+(?:type\s+)?([^'\";]*?)\s*(?:from\s*)?['\"]([^'\"]+)['\"]", text, re.M):
        clause, star = m[1], "*" in m[1]
        names = [re.sub(r"\s+as\s+.*", "", x).strip() for x in re.sub(r"[{}]|\*\s+as\s+", " ", clause).split(",")]
        yield m.start(), m[2], [n for n in names if n], star, {}
    for m in re.finditer(r"^[ \t]*export\s+(?:\*|\{[^}]*\})[^'\";]*from\s*['\"]([^'\"]+)['\"]", text, re.M):
        yield m.start(), m[1], [], True, {}
    for m in re.finditer(rf"(?:(?:const|let|var)\s+(\{{[^}}]*\}}|{_ID})\s*=\s*)?\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", text):
        yield m.start(), m[2], [x.split(":")[0].strip() for x in (m[1] or "").strip("{} ").split(",") if x.strip()], False, {}


def _imports_java(code: str, text: str):
    for m in re.finditer(r"^[ \t]*import\s+(?:static\s+)?([\w.]+)(\.\*)?\s*;", code, re.M):
        yield m.start(), m[1], [] if m[2] else [_last(m[1])], bool(m[2]), {}


def _imports_csharp(code: str, text: str):
    for m in re.finditer(r"^[ \t]*(?:global +)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", code, re.M):
        yield m.start(), m[2], [f"{m[2]} as {m[1]}" if m[1] else _last(m[2])], False, {}


def _imports_ruby(code: str, text: str):
    for m in re.finditer(r"^[ \t]*(require|require_relative|load)[ (]+['\"]([^'\"]+)['\"]", text, re.M):
        yield m.start(), m[2], [_last(m[2].removesuffix(".rb"))], False, {"require_type": m[1], "relative": m[1] == "require_relative", "load": m[1] == "load"}


def _imports_lua(code: str, text: str):
    for m in re.finditer(rf"(?:local\s+({_ID})\s*=\s*)?\brequire\s*\(?\s*['\"]([^'\"]+)['\"]", text):
        yield m.start(), m[2], [m[1] or _last(m[2])], False, {}


def _imports_swift(code: str, text: str):
    for m in re.finditer(r"^[ \t]*(?:@\w+ +)*import +(?:(?:class|struct|enum|protocol|func|var|let|typealias) +)?([\w.]+)", code, re.M):
        yield m.start(), m[1], [_last(m[1])], False, {}


def _imports_haskell(code: str, text: str):
    for m in re.finditer(r"^import +(qualified +)?([\w.]+)(?: +(qualified))?(?: +as +([\w.]+))?(?: +hiding)? *(\([^\n]*\))?", code, re.M):
        names = [x for x in re.findall(r"[A-Za-z_]\w*'*", m[5] or "")]
        yield m.start(), m[2], [f"{m[2]} as {m[4]}"] if m[4] else names or [_last(m[2])], not m[5], {"qualified": bool(m[1] or m[3])}


def _imports_scala(code: str, text: str):
    for m in re.finditer(r"^[ \t]*import +([\w.]+?)(?:\.(\{[^}]*\}|_|\*))?[ \t]*$", code, re.M):
        picked = m[2] or ""
        if picked.startswith("{"):
            yield m.start(), m[1], [re.sub(r"\s*=>.*", "", x).strip() for x in picked.strip("{}").split(",")], False, {}
        elif picked:
            yield m.start(), m[1], [], True, {}
        else:
            yield m.start(), m[1], [_last(m[1])], False, {}


_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|partial|open|fileprivate|unsafe|extern|synchronized|native|default|readonly|const|implicit|lazy|case|mutating|required|convenience|class|export|declare|strictfp|transient|volatile|new|inline)\s+)"
_ANY = r"(?:@[\w.]+(?:\([^)]*\))?\s+)*"
_TYPE = r"[\w.:<>\[\],?&* ]+?"


def _c_function(prefix: str = "") -> str:
    # The last word of the type may stand on the line before.
    return rf"^{prefix}(?:[A-Za-z_][\w:<>,&*]*[ \t*&]+)*[A-Za-z_][\w:<>,&*]*(?:[ \t*&]+|[ \t*&]*\n[ \t*&]*)(?P<name>[A-Za-z_~][\w:~]*)\s*\([^;{{}}]*\)\s*(?:const\s*|noexcept\s*|override\s*|->\s*[\w:<>]+\s*)*(?::[^;{{}}]*)?(?=\{{)"


_CONTROL = {"if", "for", "while", "switch", "return", "else", "catch", "do", "new", "throw", "case", "using", "lock", "foreach"}


def _unless_control(kind: str) -> Callable[[re.Match], str | None]:
    """The kind, unless the pattern met a statement."""
    return lambda m: None if m["name"] in _CONTROL or re.match(r"\s*(?:return|else|throw|new|case|await|yield|goto|using|delete|typedef)\b", m[0]) else kind


_C_LEX = Lexical(char_quote=True)
_JS_LEX = Lexical(quotes=('"', "'", "`"))
_JS = (
    Definition(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^>]*>)?\s*\(", "function"),
    Definition(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)(?:\s*:[^=]+)?|[\w$]+)\s*=>", "arrow"),
    Definition(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<base>[\w$.]+)(?:<[^{]*?>)?)?(?:\s+implements\s+(?P<impls>[^{]+))?\s*(?=\{)", "class", _meta(extends="base", implements="impls")),
    Definition(r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?#?(?P<name>[\w$]+)\s*(?:<[^>]*>)?\([^;{}]*\)\s*(?::[^{};=]+)?(?=\{)", _unless_control("method")),
)

LANGUAGES: dict[str, Language] = {
    "rust": Language(
        "rust",
        _C_LEX,
        (
            Definition(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"\s*\"\s+)?)*fn\s+(?P<name>\w+)", "fn"),
            Definition(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?P<kind>struct|enum|mod)\s+(?P<name>\w+)", lambda m: m["kind"]),
            Definition(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)", "trait"),
            Definition(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)", "type"),
            Definition(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?P<kind>const|static)\s+(?:mut\s+)?(?P<name>[A-Z_]\w*)\s*:", lambda m: m["kind"]),
            Definition(r"^[ \t]*(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?P<trait>[\w:]+)(?:<[^{]*?>)?\s+for\s+(?P<name>[\w:]+)", "impl_trait", lambda m: {"trait": m["trait"].split("::")[-1]}),
            Definition(r"^[ \t]*(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?P<name>[\w:]+)(?:<[^{]*?>)?\s*(?:where[^{]*)?(?=\{)", "impl"),
        ),
        _imports_rust,
        calls="rust",
        private=r"^(?!\s*pub)",
    ),
    "go": Language(
        "go",
        Lexical(quotes=('"', "`"), char_quote=True),
        (
            Definition(r"^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\(", "func"),
            Definition(r"^func\s+\(\s*(?:\w+\s+)?\*?(?P<receiver>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)\s*\(", "method", _meta(receiver="receiver")),
            Definition(r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<kind>struct|interface|func)?", lambda m: {"func": "func_type", None: "type"}.get(m["kind"], m["kind"])),
        ),
        _imports_go,
        types_after=True,
        private=r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)[a-z_]",
    ),
    "c": Language(
        "c",
        _C_LEX,
        (
            Definition(r"^[ \t]*typedef\s+[^;{}]*?\(\s*\*\s*(?P<name>\w+)\s*\)\s*\(", "fn_ptr"),
            Definition(r"^[ \t]*typedef\s+(?:struct|union|enum)?\s*\w*\s*(?:\{[^}]*\})?[^;{}(]*?(?P<name>\w+)\s*;", "typedef"),
            Definition(r"^[ \t]*(?:typedef\s+)?(?:static\s+)?(?P<kind>struct|union|enum)\s+(?P<name>\w+)\s*(?=\{)", lambda m: m["kind"]),
            Definition(_c_function(), _unless_control("fn")),
            Definition(r"^(?:static\s+|extern\s+|const\s+|unsigned\s+)*(?!typedef|return|struct\s+\w+\s*\{)[A-Za-z_]\w*[ \t*]+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?:=[^;]*)?;", _unless_control("var")),
        ),
        _imports_c,
        types_after=False,
        private=r"\bstatic\b",
    ),
    "cpp": Language(
        "cpp",
        _C_LEX,
        (
            Definition(r"^[ \t]*template\s*<(?P<params>[^{;]*?)>\s*(?P<kind>class|struct)\s+(?P<name>\w+)", lambda m: f"template_{m['kind']}", lambda m: {"template_params": [x.split()[-1] for x in m["params"].split(",") if x.strip()]}),
            Definition(r"^[ \t]*template\s*<(?P<params>[^{;]*?)>\s*(?!class\b|struct\b)(?:[A-Za-z_][\w:<>,&*]*[ \t*&]+)+(?P<name>[A-Za-z_][\w:]*)\s*\([^;{}]*\)[^;{}]*(?=\{)", "template_fn", lambda m: {"template_params": [x.split()[-1] for x in m["params"].split(",") if x.strip()]}),
            Definition(r"^[ \t]*(?P<kind>class|struct)\s+(?P<name>\w+)(?:\s+final)?(?:\s*:\s*(?P<bases>[^{;]+))?\s*(?=\{)", lambda m: m["kind"], _meta(bases="bases")),
            Definition(r"^[ \t]*namespace\s+(?P<name>[\w:]+)\s*(?=\{)", "namespace"),
            Definition(_c_function("[ \\t]*"), _unless_control("fn")),
        ),
        _imports_c,
        types_after=False,
        private=r"\bstatic\b",
    ),
    "javascript": Language("javascript", _JS_LEX, _JS, _imports_js),
    "typescript": Language(
        "typescript",
        _JS_LEX,
        (
            *_JS,
            Definition(r"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<base>[^{]+))?\s*(?=\{)", "interface", _meta(extends="base")),
            Definition(r"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(?P<name>\w+)(?:<[^=]*>)?\s*=", "type"),
            Definition(r"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>\w+)", "enum"),
        ),
        _imports_js,
    ),
    "java": Language(
        "java",
        _C_LEX,
        (
            Definition(rf"^[ \t]*{_ANY}{_MOD}*class\s+(?P<name>\w+)(?:<[^{{]*?>)?(?:\s+extends\s+(?P<base>[\w.]+)(?:<[^{{]*?>)?)?(?:\s+implements\s+(?P<impls>[^{{]+))?\s*(?=\{{)", "class", _meta(extends="base", implements="impls")),
            Definition(rf"^[ \t]*{_ANY}{_MOD}*interface\s+(?P<name>\w+)(?:<[^{{]*?>)?(?:\s+extends\s+(?P<base>[^{{]+))?\s*(?=\{{)", "interface", _meta(extends="base")),
            Definition(rf"^[ \t]*{_ANY}{_MOD}*enum\s+(?P<name>\w+)", "enum"),
            Definition(rf"^[ \t]+{_ANY}{_MOD}*(?:<[^>]+>\s+)?(?!new\b|return\b|throw\b|else\b)[A-Za-z_][\w.<>\[\],? ]*?\s+(?P<name>\w+)\s*\([^;{{}}()]*(?:\([^)]*\)[^;{{}}()]*)*\)\s*(?:throws\s+[\w., ]+)?\s*(?=\{{|;)", lambda m: None if "=" in m[0].split("(")[0] or m["name"] in _CONTROL else _unless_control("method")(m), lambda m: {"native": True} if " native " in m[0] else {}),
            Definition(rf"^[ \t]+{_ANY}{_MOD}+(?!class\b|interface\b|enum\b)[\w.<>\[\],? ]+?\s+(?P<name>\w+)\s*(?:=[^;{{]*)?;", "field"),
        ),
        _imports_java,
        types_after=False,
    ),
    "ruby": Language(
        "ruby",
        Lexical(line=("#",), block=(("\n=begin", "\n=end"),)),
        (
            Definition(r"^[ \t]*def\s+self\.(?P<name>[\w?!=]+)", "class_method"),
            Definition(r"^[ \t]*def\s+(?!self\.)(?P<name>[\w?!=]+)", "method"),
            Definition(r"^[ \t]*class\s+(?P<name>[A-Z][\w:]*)(?:\s*<\s*(?P<base>[\w:]+))?", "class", _meta(superclass="base")),
            Definition(r"^[ \t]*module\s+(?P<name>[A-Z][\w:]*)", "module"),
        ),
        _imports_ruby,
        end=lambda code, at: keyword_end(code, at, r"(?<![.:])(?:def|class|module|do|begin|case)|(?<=\n)[ \t]*(?:if|unless|while|until)"),
        functions=("method", "class_method"),
        private=r"^\s*private\b",
    ),
    "lua": Language(
        "lua",
        Lexical(line=("--",), block=(("--[[", "]]"), ("[[", "]]"))),
        (
            Definition(r"^[ \t]*local\s+function\s+(?P<name>\w+)", "local_function"),
            Definition(r"^[ \t]*function\s+(?P<owner>[\w.]+):(?P<name>\w+)", "method"),
            Definition(r"^[ \t]*function\s+(?P<name>[\w.]+)\s*\(", "function"),
        ),
        _imports_lua,
        separators=r"\.|:",
        end=lambda code, at: keyword_end(code, at, r"function|then|do|repeat"),
        functions=("function", "local_function", "method"),
        private=r"^\s*local\b",
    ),
    "swift": Language(
        "swift",
        Lexical(quotes=('"',)),
        (
            Definition(rf"^[ \t]*{_ANY}{_MOD}*func\s+(?P<name>\w+)", "func"),
            Definition(rf"^[ \t]*{_ANY}(?:(?:public|private|internal|open|final|fileprivate)\s+)*(?P<kind>class|struct|protocol|enum)\s+(?P<name>(?!func\b|var\b|let\b)\w+)(?:<[^{{]*?>)?(?:\s*:\s*(?P<bases>[^{{]+?))?\s*(?=\{{)", lambda m: m["kind"], _meta(inherits="bases")),
            Definition(rf"^[ \t]+{_ANY}{_MOD}*(?:var|let)\s+(?P<name>\w+)\s*:", "property"),
        ),
        _imports_swift,
        functions=("func",),
    ),
    "haskell": Language(
        "haskell",
        Lexical(line=("--",), block=(("{-", "-}"),), quotes=('"',)),
        (
            Definition(r"^(?P<name>[a-z_][\w']*)\s*::", "signature"),
            Definition(r"^(?P<name>(?!module\b|import\b|data\b|newtype\b|type\b|class\b|instance\b|where\b|infix|foreign\b|deriving\b|default\b)[a-z_][\w']*)(?:\s+[^\s=|:][^=|\n]*)?\s*(?:=(?!=)|\n?[ \t]*\|)", "function"),
            Definition(r"^(?:data|newtype)\s+(?:[^=\n]*=>\s*)?(?P<name>[A-Z]\w*)(?P<vars>(?:\s+[a-z]\w*)*)", "data", lambda m: {"type_vars": m["vars"].split()} if m["vars"].split() else {}),
            Definition(r"^type\s+(?P<name>[A-Z]\w*)", "type"),
            Definition(r"^class\s+(?:[^=\n]*=>\s*)?(?P<name>[A-Z]\w*)", "class"),
            Definition(r"^instance\s+(?:[^=\n]*=>\s*)?(?P<name>[A-Z][\w ]*?)\s*(?:where|$)", "instance"),
        ),
        _imports_haskell,
        calls="haskell",
        end=indent_end,
        functions=("function",),
        private=r"(?!)",
    ),
    "csharp": Language(
        "csharp",
        _C_LEX,
        (
            Definition(rf"^[ \t]*{_MOD}*(?P<kind>class|interface|struct|record)\s+(?:struct\s+|class\s+)?(?P<name>\w+)(?:<(?P<params>[^>]*)>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<bases>[^{{;]+?))?\s*(?:where[^{{]*)?(?=\{{|;)", lambda m: m["kind"], _meta(bases="bases", type_params="params")),
            Definition(rf"^[ \t]*{_MOD}*enum\s+(?P<name>\w+)", "enum"),
            Definition(rf"^[ \t]+(?:\[[^\]]*\]\s*)*{_MOD}*(?!new\b|return\b|throw\b|else\b|await\b)[A-Za-z_][\w.<>\[\],? ]*?\s+(?P<name>\w+)\s*(?:<[^>]*>)?\([^;{{}}()]*(?:\([^)]*\)[^;{{}}()]*)*\)\s*(?:where[^{{]*)?(?=\{{|=>|;)", lambda m: None if "=" in m[0].split("(")[0] else _unless_control("method")(m), lambda m: {"static": True} if " static " in m[0] else {}),
            Definition(rf"^[ \t]+{_MOD}+(?!class\b|interface\b)[\w.<>\[\],? ]+?\s+(?P<name>\w+)\s*(?=\{{\s*(?:get|set|init|private|protected|internal))", "property"),
            Definition(rf"^[ \t]+{_MOD}+(?!class\b|event\b|using\b)[\w.<>\[\],? ]+?\s+(?P<name>\w+)\s*(?:=[^;{{]*)?;", "field"),
        ),
        _imports_csharp,
        calls="methods",
        types_after=False,
    ),
    "scala": Language(
        "scala",
        Lexical(quotes=('"',)),
        (
            Definition(rf"^[ \t]*{_ANY}{_MOD}*(?P<kind>class|trait|object|enum)\s+(?P<name>\w+)(?:\[(?P<params>[^\]]*)\])?", lambda m: m["kind"], lambda m: {k: v for k, v in {"case": bool(re.search(r"\bcase\b", m[0])), "type_params": _list(m["params"])}.items() if v}),
            Definition(rf"^[ \t]*{_ANY}{_MOD}*def\s+(?P<name>\w+)", "function"),
        ),
        _imports_scala,
        calls="methods",
        functions=("function",),
    ),
}


def _empty() -> Facts:
    return {"imports": [], "definitions": [], "calls": [], "type_refs": []}


def parse(source: str, language: str) -> Facts:
    """The facts of one file, in the order of its text."""
    if language == "python":
        return _parse_python(source)
    lang = LANGUAGES.get(language)
    return _parse_patterns(source, lang) if lang else _empty()


def _anywhere(pattern: str) -> str:
    """The pattern of a line's start, also after a brace or semicolon within a line."""
    if pattern.startswith(r"^[ \t]*"):
        return r"(?:^|(?<=[{;}]))[ \t]*" + pattern.removeprefix(r"^[ \t]*")
    if pattern.startswith(r"^[ \t]+"):
        return r"(?:^[ \t]+|(?<=[{;}])[ \t]*)" + pattern.removeprefix(r"^[ \t]+")
    return pattern


@functools.cache
def _compiled(name: str) -> list[tuple[Definition, re.Pattern]]:
    """The definitions of a language with their patterns."""
    lang = LANGUAGES[name]
    return [(d, re.compile(_anywhere(d.pattern) if lang.end is brace_end else d.pattern, re.M)) for d in lang.definitions]


_HEAD = re.compile(r"[{;]|=>|\n")


def _parse_patterns(source: str, lang: Language) -> Facts:
    code, text = mask(source, lang.lexical)
    code = _blank(code, lang)
    places, lines, facts = Places(source), source.split("\n"), _empty()
    for at, path, names, star, meta in lang.imports(code, text):
        line, column = places.at(at)
        facts["imports"].append({"module_path": path, "imported_names": names, "is_glob": star, "metadata": _json(meta), "line": line, "column": column})

    found: dict[int, tuple[int, int, str, re.Match, Definition]] = {}
    for d, pattern in _compiled(lang.name):
        for m in pattern.finditer(code):
            kind = d.kind(m) if callable(d.kind) else d.kind
            if kind and m.start("name") not in found:
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                found[m.start("name")] = (start, max(m.end(), lang.end(code, m.start("name"))), kind, m, d)
    ordered = sorted(found.values(), key=lambda x: (x[0], -x[1]))
    seen: set[str] = set()
    for start, end, kind, m, d in ordered:
        if lang.name == "haskell" and kind == "function":
            if m["name"] in seen:  # one definition has an equation for each case
                continue
            seen.add(m["name"])
        owner = next((x[3]["name"] for x in reversed(ordered) if x[0] < start and end <= x[1] and x[2] not in ("namespace", "mod")), None)
        (l1, c1), (l2, c2) = places.at(start), places.at(max(start, end - 1))
        head = _HEAD.split(source[start:end], maxsplit=1)[0]
        facts["definitions"].append(
            {"kind": kind, "name": m["name"], "parent": owner, "signature": head.strip() or None, "is_public": not re.search(lang.private, head), "doc": docs.before(lines, l1 - 1, lang.name), "metadata": _json(d.metadata(m) if d.metadata else {}), "start_line": l1, "start_column": c1, "end_line": l2, "end_column": c2 + 1}
        )
    functions = [(s, e, m["name"]) for s, e, k, m, _ in ordered if k in lang.functions or k in ("arrow", "template_fn")]
    heads = [m.span("name") for _, _, _, m, _ in ordered]
    starts = sorted(heads)
    # Blocks whose members look like calls: methods without bodies, variants of an enum.
    members = [(s, e) for s, e, k, _, _ in ordered if (lang.name, k) in _MEMBERS]
    inner = [(s, e, k) for s, e, k, _, _ in ordered]

    def declared(at: int) -> bool:
        i = bisect.bisect_right(starts, (at, len(code))) - 1
        return i >= 0 and starts[i][0] <= at < starts[i][1]

    def unmade(at: int) -> bool:
        """Whether a name stands where a class lists its members."""
        if lang.name == "cpp":
            return block(at) in ("class", "struct", "template_class", "template_struct") and "=" not in code[code.rfind("\n", 0, at) + 1 : at]
        return lang.name == "typescript" and block(at) in ("class", "interface") and _is_signature(code, at)

    def block(at: int) -> str:
        """The kind of the innermost definition around a place."""
        return min(((e - s, k) for s, e, k in inner if s <= at < e), default=(0, ""))[1]

    def caller(at: int) -> str:
        return next((name for s, e, name in reversed(functions) if s <= at < e), "")

    for at, callee, receiver, kind in _calls(code, lang):
        if not declared(at) and not any(s < at < e for s, e in members) and not unmade(at):
            facts["calls"].append({"caller": caller(at), "callee": callee, "receiver": receiver, "call_kind": kind, "line": places.line(at)})
    for s, e, name in functions:
        for type_name, kind in _signature_types(code, s, e, lang):
            facts["type_refs"].append({"source": name, "type_name": type_name, "ref_kind": kind, "line": places.line(s)})
    return facts


def _json(meta: dict) -> dict[str, str]:
    return {k: json.dumps(v, ensure_ascii=False) for k, v in meta.items()}


_MEMBERS = {("go", "interface"), ("rust", "enum"), ("typescript", "interface"), ("java", "enum_constant")}
_OPEN = {")": "(", "]": "[", "}": "{"}
#: Words after which a name and its bracket are an expression, not a declaration.
_EXPRESSION = _words("return else throw co_return co_await co_yield case goto and or not do in delete await yield new")


def _blank(code: str, lang: Language) -> str:
    """Attributes and preprocessor lines as spaces."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    if lang.name in ("c", "cpp"):
        return re.sub(r"^[ \t]*#(?:[^\n]*\\\n)*[^\n]*", blank, code, flags=re.M)
    if lang.name == "csharp":
        return re.sub(r"^[ \t]*(?:\[[A-Za-z_][^\]\n]*\][ \t]*)+", blank, code, flags=re.M)
    if lang.name == "rust":
        for m in reversed(list(re.finditer(r"#!?\[", code))):
            end = close(code, m.end() - 1)
            code = code[: m.start()] + re.sub(r"[^\n]", " ", code[m.start() : end]) + code[end:]
    return code


def _is_signature(code: str, at: int) -> bool:
    """Whether the name at a place of a class is that of a method without a body."""
    opened = code.find("(", at)
    after = re.match(r"\s*(?::[^;{}=]+)?;", code[close(code, opened) :]) if opened >= 0 else None
    return bool(after) and bool(re.fullmatch(r"\s*(?:(?:public|private|protected|static|abstract|declare|async|readonly|override|get|set)\s+)*", code[code.rfind("\n", 0, at) + 1 : at]))


def _opened(code: str, at: int) -> int:
    """The offset of the bracket that the one at ``at`` closes; -1 if none is."""
    closer, opener, depth = code[at], _OPEN[code[at]], 0
    for i in range(at, -1, -1):
        depth += (code[i] == closer) - (code[i] == opener)
        if depth == 0:
            return i
    return -1


@functools.cache
def _separated(separators: str) -> tuple[re.Pattern, re.Pattern]:
    """Of a separator before a name, and of those and type arguments in an expression."""
    return re.compile(rf"(?<!\.)(?:{separators})\s*$"), re.compile(rf"(?:::)?<[^<>]*>(?={separators})|(?:{separators})$")


def _receiver(code: str, at: int, separators: str) -> tuple[int, str, str]:
    """Where the expression before a name begins, its text, and the separator that joins them; without one the name's place."""
    start, text, joint = at, "", ""
    before, within = _separated(separators)
    while True:
        near = code[max(0, start - 200) : start]
        # All separators end in one of these.
        sep = near.rstrip().endswith((".", ":", ">")) and before.search(near)
        if not sep:
            return start, text, joint
        end = max(0, start - 200) + sep.start()
        joint = joint or sep[0].strip()
        i = len(code[:end].rstrip())
        if i and code[i - 1] == ">" and "::" in separators:  # type arguments
            i = code.rfind("<", 0, i)
            i = len(code[: max(0, i)].removesuffix("::"))
        while i and code[i - 1] in ")]}":
            j = _opened(code, i - 1)
            if j < 0:
                break
            i = len(code[:j].rstrip()) if code[i - 1] != "}" else j
            if code[j] == "{":
                break
        word = re.search(r"[@$]{0,2}[\w$]+[?!]?$", code[max(0, i - 200) : i])
        i = max(0, i - 200) + word.start() if word else i
        if i == start or i >= end:
            return start, text, joint
        start, text = i, re.sub(r"\s+", "", code[i:at])
        text = within.sub("", text)


def _is_pattern(code: str, at: int, end: int) -> bool:
    """Whether a name with brackets, of Rust, is a pattern: of an arm, or left of an assignment by let."""
    after = code[end : end + 300]
    guard = re.search(r"\bif\b(?!\s+let\b)[^{};,]*$", code[max(0, at - 300) : at])
    if not guard and re.match(r"[\s)]*(?:\|\s*[\w:]+\s*(?:\([^()]*\))?\s*)*(?:=>|if\b[^{};]*?=>)", after):
        return True
    return bool(re.match(r"[\s)]*=(?!=)", after)) and bool(re.search(r"\blet\b[^=;{}]*$", code[max(0, at - 300) : at]))


def _is_declaration(code: str, at: int, end: int) -> bool:
    """Whether a name with brackets, of C, C++ or C#, declares a function or an object: a type stands before it."""
    before = code[code.rfind("\n", 0, at) + 1 : at]
    word = re.search(r"([A-Za-z_]\w*|[>\]])[ \t]+$", before)
    if word and word[1] not in _EXPRESSION:
        return True
    return bool(re.fullmatch(r"\s*(?:[A-Za-z_][\w:<>,]*\s+)*[A-Za-z_][\w:<>,]*\s*[*&]+\s*", before)) and code[end : end + 20].lstrip().startswith(";")


def _initialisers(code: str) -> set[int]:
    """Where the names of C++ constructors' initialisers stand."""
    out: set[int] = set()
    for m in re.finditer(r"\)\s*(?:noexcept\s*)?:(?!:)", code):
        i = m.end()
        while name := re.compile(r"\s*([\w:<>]+)\s*(?=[({])").match(code, i):
            out.add(name.start(1))
            i = close(code, name.end())
            more = re.compile(r"\s*,").match(code, i)
            if not more:
                break
            i = more.end()
        else:
            continue
    return out


def _calls_ruby(code: str, lang: Language):
    plain = re.compile(r"(?<![\w.:@$&])(?P<name>[A-Za-z_]\w*[?!]?)\((?!\s*\|)")
    command = re.compile(r"(?:^|(?<=[;{|]))[ \t]*(?:(?:return|then|else|do)[ \t]+)?(?P<name>[a-z_]\w*[?!]?)[ \t]+(?=[:\w\"'@\[{&*-])(?![-*&][ \t=])(?!(?:if|unless|while|until|and|or|then|do|end|in|rescue)\b)", re.M)
    member = re.compile(r"(?:(?<![.\d])&?\.(?!\.)|::(?=[a-z_]))\s*(?P<name>[A-Za-z_]\w*[?!]?)")
    found = {}
    for pattern in (plain, command):
        for m in pattern.finditer(code):
            found[m.start("name")] = (m["name"], None, "direct")
    for m in member.finditer(code):
        start, text, _ = _receiver(code, m.start("name"), r"&?\.|::")
        if text:
            found[m.start("name")] = (m["name"], text, "method")
    for at, (name, receiver, kind) in sorted(found.items()):
        if kind == "method" or name not in lang.keywords:
            yield at, name, receiver, kind


def _calls_haskell(code: str):
    for m in re.finditer(r"(?<![\w.'])([a-z_][\w']*)[ \t]+(?=[\w(\"\['])", code):
        line = code[code.rfind("\n", 0, m.start()) + 1 : m.start()]
        if "=" in line and m[1] not in _HASKELL:
            yield m.start(1), m[1], None, "direct"


_HASKELL = _words("in let of then else if case where do return deriving data newtype type class instance module import forall infix infixl infixr as qualified hiding")


@functools.cache
def _called(language: str) -> re.Pattern:
    """A name before a bracket, with type arguments as the language writes them."""
    generic = r"(?:::)?(?:<[\w:, <>?\[\]]*>)?" if language not in ("c", "lua", "go", "scala") else r"(?:\[[\w, ]*\])?" if language in ("go", "scala") else ""
    return re.compile(rf"(?<![\w$])(?P<name>[A-Za-z_$][\w$]*)\s*{generic}\s*\(")


def _calls(code: str, lang: Language):
    """(offset of the name, callee, receiver, kind) of everything that is a call."""
    none = NO_CALLS.get(lang.name, frozenset())
    if lang.calls == "haskell":
        yield from _calls_haskell(code)
        return
    if lang.name == "ruby":
        yield from (x for x in _calls_ruby(code, lang) if x[1] not in none)
        return
    macros = [(m.start(1), m.end(), close(code, m.end() - 1)) for m in re.finditer(r"(?<![\w$])([A-Za-z_]\w*)\s*!\s*[(\[{]", code)] if lang.calls == "rust" else []
    skip = _initialisers(code) if lang.name == "cpp" else set()
    for at, opened, end in macros:
        # What a macro is given is no code yet.
        if not any(a <= at < b for _, a, b in macros if a != opened):
            yield at, re.match(r"\w+", code[at:])[0], None, "macro"
    for m in _called(lang.name).finditer(code):
        name, at = m["name"], m.start("name")
        start, path, joint = _receiver(code, at, lang.separators)
        if name in lang.keywords and not path or not path and name in none or at in skip or start in skip:
            continue
        before = code[max(0, start - 40) : start]
        if before.endswith("@") and lang.name not in ("javascript", "typescript"):
            continue
        if any(a <= at < b for _, a, b in macros):
            continue
        end = close(code, m.end() - 1)
        if re.search(r"\bnew\s+$", before) and "(" not in path:  # an object's creation is no call, but what is called on it
            continue
        if lang.calls == "rust":
            if _is_pattern(code, at, end):
                continue
            if joint == "::":
                if path in ("self", "Self"):
                    yield at, name, "self", "method"
                else:
                    yield at, f"{path}::{name}", path, "constructor" if name[0].isupper() else "associated"
            else:
                yield at, name, path or None, "method" if path else "direct"
        elif lang.name in ("c", "cpp", "csharp") and not path and _is_declaration(code, at, end):
            continue
        elif lang.calls == "methods":
            yield at, name, path or None, "method"
        elif lang.name == "go":
            if not path and before.rstrip().endswith("]"):  # a conversion
                continue
            if path and name[0].isupper():
                yield at, f"{path}.{name}", path, "constructor"
            else:
                yield at, name, path or None, "method" if path else "direct"
        else:
            yield at, name, path or None, "method" if path else "direct"


#: Words of a signature that name no type.
_NO_TYPES = frozenset({"mut", "dyn", "impl", "ref", "const", "where", "for", "static", "final", "in", "out", "inout", "throws", "async", "struct", "enum", "class", "unsigned", "signed", "readonly", "this", "params", "template", "typename", "inline", "virtual", "map", "chan", "interface", "func", "public", "private", "protected", "override", "extends"})
_ONE_TYPE = re.compile(r"(?<!')\b[A-Za-z_][\w.:]*")
_LAST_NAME = re.compile(rf"{_ID}\s*$")
_MODIFIERS = re.compile(_MOD)


def _signature_types(code: str, start: int, end: int, lang: Language) -> list[tuple[str, str]]:
    """(type, parameter or return) named by a function's head, each once, without those of the language itself."""
    if lang.name in ("javascript", "ruby", "lua", "haskell"):
        return []
    head = re.split(r"[{;]", code[start:end], maxsplit=1)[0]
    opened = head.find("(", head.find(")") + 1 if lang.name == "go" and re.match(r"func\s*\(", head) else 0)
    if opened < 0:
        return []
    depth, closed = 0, len(head)
    for i in range(opened, len(head)):
        depth += (head[i] in "([") - (head[i] in ")]")
        if depth == 0:
            closed = i
            break
    inside, before, after = head[opened + 1 : closed], head[:opened], head[closed + 1 :]
    texts = []
    for p in re.split(r",(?![^<(\[]*[>)\]])", inside):
        if lang.name == "go":
            texts.append((p.strip().split(" ", 1)[-1], "parameter"))
        elif lang.types_after:
            texts.append((p.split(":", 1)[1] if ":" in p.replace("::", "  ") else "", "parameter"))
        else:
            texts.append((re.sub(r"[\w$]+\s*(?:=.*)?$", "", p.strip()), "parameter"))
    texts.append((after if lang.types_after else _LAST_NAME.sub("", _MODIFIERS.sub(" ", before)), "return"))
    out: list[tuple[str, str]] = []
    for text, kind in texts:
        for name in _ONE_TYPE.findall(text.split("=")[0]):
            name = re.split(r"\.|::", name.strip(":."))[-1]
            if name and name not in _NO_TYPES and not is_builtin(lang.name, name) and not (len(name) == 1 and name.isupper()) and (name, kind) not in out:
                out.append((name, kind))
    return out


def _parse_python(source: str) -> Facts:
    """Facts from the standard library's syntax tree; a text that does not parse raises SyntaxError."""
    facts, lines = _empty(), source.split("\n")
    at = lambda n: {"line": n.lineno, "column": n.col_offset + 1}

    def types(node: ast.AST | None) -> list[str]:
        out: list[str] = []
        for n in ast.walk(node) if node is not None else ():
            name = n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else None
            if name and not is_builtin("python", name) and name not in out:
                out.append(name)
        return out

    def visit(node: ast.AST, owner: str | None, caller: str) -> None:
        if isinstance(node, ast.Import):
            for a in node.names[:1]:  # further names of one statement count with the first
                facts["imports"].append({"module_path": a.name, "imported_names": [f"{a.name} as {a.asname}" if a.asname else a.name], "is_glob": False, "metadata": {}, **at(node)})
        elif isinstance(node, ast.ImportFrom):
            names = [f"{a.name} as {a.asname}" if a.asname else a.name for a in node.names if a.name != "*"]
            facts["imports"].append({"module_path": "." * node.level + (node.module or ""), "imported_names": names, "is_glob": any(a.name == "*" for a in node.names), "metadata": {}, **at(node)})
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            is_class = isinstance(node, ast.ClassDef)
            meta: dict = {"decorators": [ast.unparse(d) for d in node.decorator_list]} if node.decorator_list else {}
            if is_class and node.bases:
                meta["bases"] = [ast.unparse(b) for b in node.bases]
            if not is_class and owner:
                meta["is_method"] = True
            doc = docs.clean(d) if (d := ast.get_docstring(node)) else None
            head = lines[node.lineno - 1].strip().rstrip(":")
            facts["definitions"].append(
                {"kind": "class" if is_class else "def", "name": node.name, "parent": owner, "signature": head, "is_public": not node.name.startswith("_"), "doc": doc, "metadata": _json(meta), "start_line": node.lineno, "start_column": node.col_offset + 1, "end_line": node.end_lineno, "end_column": (node.end_col_offset or 0) + 1}
            )
            if not is_class:
                args = node.args
                for a in (*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg):
                    for name in types(a.annotation) if a else ():
                        facts["type_refs"].append({"source": node.name, "type_name": name, "ref_kind": "parameter", "line": node.lineno})
                for name in types(node.returns):
                    facts["type_refs"].append({"source": node.name, "type_name": name, "ref_kind": "return", "line": node.lineno})
            for child in ast.iter_child_nodes(node):
                visit(child, node.name if is_class else None, caller if is_class else node.name)
            return
        elif isinstance(node, ast.AnnAssign):
            for name in types(node.annotation):
                facts["type_refs"].append({"source": caller or owner or "", "type_name": name, "ref_kind": "local" if caller else "field", "line": node.lineno})
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                facts["calls"].append({"caller": caller, "callee": f.id, "receiver": None, "call_kind": "direct", "line": node.lineno})
            elif isinstance(f, ast.Attribute):
                receiver = ast.unparse(f.value)
                made = f.attr[:1].isupper()
                facts["calls"].append({"caller": caller, "callee": f"{receiver}.{f.attr}" if made else f.attr, "receiver": receiver, "call_kind": "constructor" if made else "method", "line": node.lineno})
        for child in ast.iter_child_nodes(node):
            visit(child, owner, caller)

    visit(ast.parse(source), None, "")
    return facts
