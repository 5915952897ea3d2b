"""Foreign-function bindings in source text, found line by line with built-in expressions.

A detector maps (path, content) to (path, line, source_lang, target_lang, symbol, kind). Where one line is enough, or some
lines ahead, the lines of a file stay in their row; where a block's state matters, a window over the file's lines carries
it. Only the ctypes detector follows variables through a file, and so runs in Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = "path string, line int, source_lang string, target_lang string, symbol string, kind string"
Detector = Callable[[DataFrame], DataFrame]


def _rx(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _quoted(text: Column) -> Column:
    return _rx(text, "[\"']([^\"']*)[\"']")


def _last_word(text: Column) -> Column:
    """The word before the first parenthesis."""
    return _rx(text, r"^[^(]*?([^\s(]+)\s*\(")


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.transform(F.split("content", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " "))).alias("all"))


def _numbered(files: DataFrame) -> DataFrame:
    return _lines(files).select("path", "all", F.posexplode("all").alias("at", "text"))


def _emit(rows: DataFrame, *rules: tuple[str, str | Column, str, Column]) -> DataFrame:
    """One row for each (source, target, kind, symbol) whose symbol is not null."""
    found = [F.struct(F.lit(s).alias("s"), (F.lit(t) if isinstance(t, str) else t).alias("t"), symbol.alias("symbol"), F.lit(k).alias("k")) for s, t, k, symbol in rules]
    each = rows.select("path", (F.col("at") + 1).cast("int").alias("line"), F.explode(F.filter(F.array(*found), lambda x: x["symbol"].isNotNull())).alias("b"))
    return each.select("path", "line", F.col("b.s").alias("source_lang"), F.col("b.t").alias("target_lang"), F.col("b.symbol").alias("symbol"), F.col("b.k").alias("kind"))


def _ahead(n: int, passes: Column | None, value: Callable[[Column], Column], stop: Callable[[Column], Column]) -> Column:
    """The value of the first of the next n lines that has one, unless a line before it stops the search."""
    out = F.lit(None).cast("string")
    for i in range(n, 0, -1):
        text = F.get("all", F.col("at") + i)
        here = value(text)
        out = F.when(text.isNull(), None).when(here.isNotNull(), here).when(stop(text), None).otherwise(out)
    return F.when(passes, out) if passes is not None else out


_RUST_FN = r"(?:^|.* )fn +([A-Za-z0-9_]+)"


def _stops(*allowed: str) -> Callable[[Column], Column]:
    """A line stops a search unless it is empty, a comment, or begins with one of these."""

    def stop(text: Column) -> Column:
        ok = (text == "") | text.startswith("//")
        for a in allowed:
            ok |= text.startswith(a)
        return ~ok

    return stop


def _since(opens: Column, closes: Column) -> Column:
    """Whether the last line so far that opened or closed a block opened it; a line that does both closes."""
    by = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(F.when(closes, F.lit(False)).when(opens, F.lit(True)), ignorenulls=True).over(by), F.lit(False))


def rust_extern(files: DataFrame) -> DataFrame:
    """Functions declared in ``extern "C"`` blocks."""
    t = F.col("text")
    rows = _numbered(files).withColumn("inside", _since(t.rlike("^(pub )?(unsafe )?extern [\"']C[\"'].*\\{"), t.contains("}")))
    # The block's own line does not count, a closing line may still declare.
    inside = F.col("inside") | F.lag("inside", 1, False).over(Window.partitionBy("path").orderBy("at"))
    return _emit(rows.withColumn("inside", inside), ("rust", "C", "Import", F.when(F.col("inside"), _rx(t, r"^(?:pub )?fn +([A-Za-z0-9_]+)"))))


def rust_no_mangle(files: DataFrame) -> DataFrame:
    stop = _stops("#[", "pub unsafe", "pub extern")
    return _emit(_numbered(files), ("rust", "c", "Export", _ahead(4, F.col("text").contains("#[no_mangle]"), lambda x: _rx(x, _RUST_FN), stop)))


def rust_wasm_bindgen(files: DataFrame) -> DataFrame:
    t, stop = F.col("text"), _stops("#[", "pub extern")
    return _emit(_numbered(files), ("rust", "wasm", "Export", _ahead(4, t.contains("#[wasm_bindgen]"), lambda x: _rx(x, _RUST_FN), stop)), ("rust", "wasm", "Import", F.when(t.contains("#[link(wasm_import_module"), _quoted(t))))


def go_export(files: DataFrame) -> DataFrame:
    return _emit(_numbered(files), ("go", "c", "Export", _rx(F.col("text"), r"^//export +(.*\S)")))


def go_import(files: DataFrame) -> DataFrame:
    """The first ``C.name`` of each line, from the import of "C" to a line of one parenthesis."""
    t = F.col("text")
    rows = _numbered(files).withColumn("inside", _since(t.contains('import "C"'), t == ")"))
    return _emit(rows, ("go", "c", "Import", F.when(F.col("inside"), _rx(t, r"\bC\.([A-Za-z0-9_]+)"))))


def _ctypes_symbols(content: str) -> list[tuple[int, str]]:
    handles: set[str] = set()
    makers: set[str] = set()
    current, out = None, []
    for n, raw in enumerate(content.split("\n"), 1):
        line = raw.strip()
        if m := re.match(r"def (\w+)", line):
            current = m[1]
        loads = "ctypes.CDLL" in line or "cdll.LoadLibrary" in line
        if loads:
            if m := re.match(r"(\w+)\s*=", line):
                handles.add(m[1])
            if line.startswith("return ") and current:
                makers.add(current)
        if (m := re.match(r"(\w+)\s*=\s*(\w+)\(", line)) and m[2] in makers:
            handles.add(m[1])
        if (m := re.fullmatch(r"return (\w+)", line)) and m[1] in handles and current:
            makers.add(current)
        for handle in sorted(handles):
            if not loads and (m := re.search(rf"(?<![\w.]){re.escape(handle)}\.(\w+)", line)):
                out.append((n, m[1]))
    return out


def python_ctypes(files: DataFrame) -> DataFrame:
    """Symbols of library handles, which may pass through functions that return them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, n, "python", "c", s, "Import") for p, c in zip(batch["path"], batch["content"], strict=True) if c for n, s in _ctypes_symbols(c)]
            yield pd.DataFrame(rows, columns=["path", "line", "source_lang", "target_lang", "symbol", "kind"])

    return files.select("path", "content").where("content LIKE '%CDLL%' OR content LIKE '%LoadLibrary%'").mapInPandas(run, RESULT)


_PROTOTYPE = r"([A-Za-z_][A-Za-z0-9_]*)\s*\([^()]*\)\s*;"


def python_cffi(files: DataFrame) -> DataFrame:
    """C prototypes within twenty lines of a ``cdef``."""
    t = F.col("text")
    near = _numbered(files).where(t.contains("cffi.FFI()") | t.contains("ffi.cdef(")).withColumn("text", F.array_join(F.slice("all", F.col("at") + 1, 20), " "))
    each = near.select("path", "at", F.explode(F.regexp_extract_all("text", F.lit(_PROTOTYPE), F.lit(1))).alias("text"))
    return _emit(each, ("python", "c", "Import", F.col("text")))


def ruby_ffi(files: DataFrame) -> DataFrame:
    t = F.col("text")
    return _emit(_numbered(files), ("ruby", "c", "Import", _rx(t, r"(?:^|\.)attach_function +:?[\"']?([A-Za-z0-9_?!]+)")), ("ruby", "c", "Callback", _rx(t, r"^callback +:?([A-Za-z0-9_?!]+)")))


def cpp_extern_c(files: DataFrame) -> DataFrame:
    """Functions in ``extern "C"`` blocks and after single declarations; an assignment is a type binding."""
    t, by = F.col("text"), Window.partitionBy("path").orderBy("at")
    opens = t.contains('extern "C"')
    rows = _numbered(files).withColumn("start", F.max(F.when(opens, F.col("at"))).over(by))
    net = F.length(F.regexp_replace(t, "[^{]", "")) - F.length(F.regexp_replace(t, "[^}]", ""))
    block = Window.partitionBy("path", "start").orderBy("at")
    rows = rows.withColumn("depth", F.sum(net).over(block)).withColumn("ended", F.coalesce(F.max(((F.col("depth") <= 0) & t.contains("}")).cast("int")).over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.col("start").isNotNull() & (F.col("ended") == 0)
    name = F.when(inside, _rx(t, r"^(?:extern \"C\"\s*\{?\s*)?[A-Za-z_][\w:<>,&*\s]*?[\s*&]([A-Za-z_]\w*)\s*\("))
    binds = t.contains("=") & ~t.contains("==")
    return _emit(rows, ("cpp", "c", "Export", F.when(~binds, name)), ("cpp", "c", "TypeBinding", F.when(binds, name)))


def java_native(files: DataFrame) -> DataFrame:
    t = F.col("text")
    loads = F.when(t.contains("System.loadLibrary(") | t.contains("System.load("), _rx(t, r"\(\s*\"?(.*?)\"?\s*\)[^)]*$"))
    native = F.when(t.contains(" native ") & t.contains("(") & (t.contains(";") | t.endswith(")")), _last_word(t))
    foreign = F.when((t.contains("Linker.nativeLinker()") | t.contains("downcallHandle") | t.contains("SymbolLookup")) & (t.contains("find(") | t.contains("findOrThrow(")), _rx(t, '"([^"]*)"'))
    return _emit(_numbered(files), ("java", "native", "Import", loads), ("java", "jni", "Import", native), ("java", "ffm", "Import", foreign))


def node_native(files: DataFrame) -> DataFrame:
    t = F.col("text")
    addon = F.when(t.contains(".node"), _rx(t, "require\\([\"']([^\"']*)[\"']"))
    wasm = F.when(t.rlike("^(WebAssembly\\.instantiate|WebAssembly\\.Instance|instantiateStreaming)"), _rx(t, '^[^"]*"([^"]*\\.wasm)"'))
    library = _rx(t, "ffi\\.Library\\([^\"']*[\"']([^\"']*)[\"']")
    return _emit(_numbered(files), ("javascript", "node", "Import", addon), ("javascript", "wasm", "Import", wasm), ("javascript", "ffi", "Import", library))


def swift_ffi(files: DataFrame) -> DataFrame:
    t = F.col("text")
    objc = F.when(t.contains("@objc") & ~t.contains("@objc("), _rx(t, r"func ([^(\s]+)"))
    named = F.when(t.contains("@_cdecl(") | t.contains("@_silgen_name("), _rx(t, '"([^"]*)"'))
    return _emit(_numbered(files), ("swift", "c", "Import", _rx(t, r"^import +(C\S.*)$")), ("swift", "objc", "Export", objc), ("swift", "c", "Export", named))


def lua_ffi(files: DataFrame) -> DataFrame:
    """Prototypes in a ``cdef`` block, ``ffi.C`` symbols and types of ``ffi.new``."""
    t = F.col("text")
    rows = _numbered(files).withColumn("inside", _since(t.contains("ffi.cdef[[") | t.contains("ffi.cdef("), t.contains("]]")))
    return _emit(
        rows,
        ("lua", "c", "Import", F.when(F.col("inside") & ~t.contains("ffi.cdef"), _rx(t, r"^[A-Za-z_][\w\s*]*?[\s*]([A-Za-z_]\w*)\s*\("))),
        ("lua", "c", "Import", _rx(t, r"ffi\.C\.([A-Za-z0-9_]+)")),
        ("lua", "c", "TypeBinding", _rx(t, "ffi\\.new\\([^\"']*[\"']([^\"']*)[\"']")),
    )


def haskell_ffi(files: DataFrame) -> DataFrame:
    t = F.col("text")
    imported = F.when(t.startswith("foreign import "), _rx(t, '"(?:[^"]* )?([^" ]*)"'))
    exported = F.coalesce(_rx(t, r"^foreign export +\S+ +(\S+)"), _rx(t, r"^foreign export +(\S+)"))
    pragma = F.when(t.startswith("{-# LANGUAGE") & t.contains("ForeignFunctionInterface"), F.lit("FFI_ENABLED"))
    return _emit(_numbered(files), ("haskell", "c", "Import", imported), ("haskell", "c", "Export", exported), ("haskell", "c", "TypeBinding", pragma))


def wat(files: DataFrame) -> DataFrame:
    t = F.col("text")
    both = F.concat(_rx(t, r'^\(import "([^"]*)"'), F.lit("."), _rx(t, r'^\(import "[^"]*" *"([^"]*)"'))
    return _emit(_numbered(files), ("wasm", "host", "Import", both), ("wasm", "host", "Export", _rx(t, r'^\(export "([^"]*)"')))


def csharp_native(files: DataFrame) -> DataFrame:
    """Libraries of DllImport, functions declared after it (bound to that library), entry points, COM interfaces, dynamic loading."""
    t, by = F.col("text"), Window.partitionBy("path").orderBy("at")
    imports = t.contains("[DllImport(") | t.contains("[DllImportAttribute(")
    ends = ~t.contains("extern") & ~t.contains("DllImport") & (t != "") & ~t.startswith("[") & ~t.startswith("//")
    rows = _numbered(files).withColumn("state", F.when(imports, _quoted(t)).when(ends, F.lit("")))
    rows = rows.withColumn("dll", F.nullif(F.last("state", ignorenulls=True).over(by), F.lit("")))
    declared = F.when(F.col("dll").isNotNull() & t.contains("extern"), _last_word(F.regexp_replace(t, r"^\[[^\]]*\]\s*", "")))
    entry = F.when(t.contains("EntryPoint"), _rx(t, '"([^"]*)"'))
    static = _ahead(2, None, lambda x: F.when(x.contains("static"), _last_word(x)), lambda x: F.lit(False))
    com = _ahead(4, t.contains("[ComImport"), lambda x: _rx(x, r"(?:^| )interface +([^\s{]+)"), lambda x: F.lit(False))
    dynamic = F.when(t.contains("LoadLibrary") | t.contains("GetProcAddress"), F.lit("dynamic_load"))
    return _emit(
        rows,
        ("csharp", "native", "Import", F.when(imports, _quoted(t))),
        ("csharp", F.col("dll"), "Import", declared),
        ("csharp", "native", "Export", F.when(t.contains("[UnmanagedCallersOnly"), F.coalesce(entry, static))),
        ("csharp", "com", "Import", com),
        ("csharp", "native", "Import", dynamic),
    )


def scala_native(files: DataFrame) -> DataFrame:
    t, never = F.col("text"), lambda x: F.lit(False)
    jna = F.when(t.contains("Native.load[") | t.contains("Native.load("), _rx(t, '"([^"]*)"'))
    native = F.when(t.startswith("def ") & t.contains("@native"), _rx(t, r"^def +([A-Za-z0-9_]+)"))
    loads = F.when(t.contains("System.loadLibrary(") | t.contains("System.load("), _rx(t, r"\(\s*\"?(.*?)\"?\s*\)[^)]*$"))
    place = lambda pattern: F.coalesce(_rx(t, pattern), _ahead(3, None, lambda x: _rx(x, pattern), never))
    extern = F.when(t.contains("@extern") | t.contains("@native.extern"), place(r"object +([A-Za-z0-9_]+)"))
    exported = F.when(t.contains("@exported"), place(r"def +([A-Za-z0-9_]+)"))
    unsafe = F.when(t.contains("unsafe.") | t.contains("fromCString") | t.contains("toCString"), F.lit("unsafe"))
    return _emit(_numbered(files), ("scala", "jna", "Import", jna), ("scala", "jni", "Import", native), ("scala", "jni", "Import", loads), ("scala", "native", "Import", extern), ("scala", "native", "Export", exported), ("scala", "native", "Import", unsafe))


#: The detectors that a language's parser runs; those of cffi, WAT and wasm-bindgen run on demand.
BY_LANGUAGE: dict[str, tuple[Detector, ...]] = {
    "rust": (rust_no_mangle, rust_extern),
    "go": (go_export, go_import),
    "python": (python_ctypes,),
    "ruby": (ruby_ffi,),
    "cpp": (cpp_extern_c,),
    "java": (java_native,),
    "javascript": (node_native,),
    "typescript": (node_native,),
    "swift": (swift_ffi,),
    "lua": (lua_ffi,),
    "haskell": (haskell_ffi,),
    "csharp": (csharp_native,),
    "scala": (scala_native,),
}


def detect_all(files: DataFrame) -> DataFrame:
    """The bindings of (path, language, content), by each file's own language."""
    # A few languages at most; detectors of others would only lengthen the plan.
    there = {r.language for r in files.select("language").distinct().collect()} & set(BY_LANGUAGE) or {"rust"}
    parts = [detector(files.where(F.col("language") == language)) for language, detectors in BY_LANGUAGE.items() if language in there for detector in detectors]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


#: For each detector a text with a name in it, and what it must find there.
EXAMPLES: dict[str, tuple[Detector, str, str, str, str, str]] = {
    "rust_extern": (rust_extern, 'use x;\nextern "C" {\n    fn %s(a: i32) -> i32;\n}\nfn own() {}', "rust", "C", "Import", "name"),
    "rust_no_mangle": (rust_no_mangle, '#[no_mangle]\n// kept\npub extern "C" fn %s() {}\nfn own() {}', "rust", "c", "Export", "name"),
    "wasm_bindgen": (rust_wasm_bindgen, "#[wasm_bindgen]\n#[inline]\npub fn %s() {}", "rust", "wasm", "Export", "name"),
    "go_export": (go_export, "package main\n//export %s\nfunc f() {}", "go", "c", "Export", "name"),
    "go_import": (go_import, 'import "C"\nx := C.%s(1)\n)\ny := C.other()', "go", "c", "Import", "name"),
    "python_ctypes": (python_ctypes, "def load():\n    return ctypes.CDLL('a.so')\nlib = load()\nlib.%s(1)", "python", "c", "Import", "name"),
    "python_cffi": (python_cffi, 'ffi.cdef("""\n    int %s(int a);\n""")', "python", "c", "Import", "name"),
    "ruby": (ruby_ffi, "module A\n  attach_function :%s, [:int], :int\nend", "ruby", "c", "Import", "name"),
    "cpp": (cpp_extern_c, 'extern "C" {\nint %s(int a);\n}\nint other(int b);', "cpp", "c", "Export", "name"),
    "java": (java_native, "class A {\n  public native int %s(int a);\n}", "java", "jni", "Import", "name"),
    "node": (node_native, "const a = require('./%s.node');", "javascript", "node", "Import", "'./' || name || '.node'"),
    "swift": (swift_ffi, "import Foundation\n@objc func %s() {}", "swift", "objc", "Export", "name"),
    "lua": (lua_ffi, "ffi.cdef[[\nint f;\n]]\nffi.C.%s(1)", "lua", "c", "Import", "name"),
    "haskell": (haskell_ffi, 'foreign import ccall "math.h %s" c_f :: Double', "haskell", "c", "Import", "name"),
    "wat": (wat, '(module\n  (import "env" "%s" (func))\n)', "wasm", "host", "Import", "'env.' || name"),
    "csharp": (csharp_native, '[ComImport]\n[Guid("1")]\npublic interface %s {\n}', "csharp", "com", "Import", "name"),
    "scala": (scala_native, '@extern\nobject %s {\n}', "scala", "native", "Import", "name"),
}
