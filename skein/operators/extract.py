"""Extraction of symbols, imports and calls from source text by per-language patterns, and masks of comments and strings.

One file in, many rows out: an Arrow-batched Python operator, since a lexer's state runs over a whole file.  Patterns
work on text whose comments and strings are blanked, lines kept.  A file that a pattern cannot read gives no rows and is
marked partial; it never fails the batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import bounded_batches

# --- lexing ----------------------------------------------------------------

#: language -> line comment marks, block comment ends, quotes.
LEXERS: dict[str, tuple[tuple[str, ...], tuple[tuple[str, str], ...], tuple[str, ...]]] = {
    **{n: (("//",), (("/*", "*/"),), ('"', "'")) for n in ("Java", "Kotlin", "C", "Cpp", "ObjC", "ObjCpp", "CSharp", "Swift", "Dart", "Proto")},
    **{n: (("//",), (("/*", "*/"),), ("`", '"', "'")) for n in ("TypeScript", "Tsx", "JavaScript", "Vue", "Go")},
    "Rust": (("//",), (("/*", "*/"),), ('"',)),
    "Php": (("//", "#"), (("/*", "*/"),), ('"', "'")),
    "Python": (("#",), (), ('"""', "'''", '"', "'")),
    "Ruby": (("#",), (("\n=begin", "\n=end"),), ('"', "'")),
    "Shell": (("#",), (), ('"', "'")),
    "Lua": (("--",), (("--[[", "]]"),), ("[[", '"', "'")),
    "VisualBasic": (("'",), (), ('"',)),
}


@cache
def _marks(language: str) -> tuple[re.Pattern[str], dict[str, str]]:
    """A finder of the marks that open something, and how each is closed."""
    line_marks, blocks, quotes = LEXERS[language]
    opens = sorted([*((m, "line") for m in line_marks), *((a, b) for a, b in blocks), *((q, "quote") for q in quotes)], key=lambda x: -len(x[0]))
    return re.compile("|".join(re.escape(m) for m, _ in opens)), dict(opens)


@lru_cache(maxsize=4)  # symbols, imports and calls of a file read the same text
def spans(text: str, language: str) -> list[tuple[int, int, str]]:
    """(start, end, 'comment' or 'string') in order; end marks are inside.  Unknown languages have none."""
    if language not in LEXERS:
        return []
    finder, closes = _marks(language)
    out, at = [], 0
    while m := finder.search(text, at):
        mark, start = m[0], m.start()
        how = closes[mark]
        if mark == "#" and language == "Shell" and start and not text[start - 1].isspace():
            at = m.end()
            continue
        if how == "line":
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
            out.append((start, end, "comment"))
        elif how == "quote":
            close = "]]" if mark == "[[" else mark
            end = m.end()
            while True:
                stop = text.find(close, end)
                line = text.find("\n", end) if len(mark) == 1 and mark != "`" else -1
                if stop < 0 or 0 <= line < stop:
                    end = line if line >= 0 else len(text)
                    break
                slashes = len(text[:stop]) - len(text[:stop].rstrip("\\")) if stop and text[stop - 1] == "\\" and mark != "[[" else 0
                end = stop + len(close)
                if slashes % 2 == 0:
                    break
            out.append((start, end, "string"))
        else:
            stop = text.find(how, m.end())
            end = len(text) if stop < 0 else stop + len(how)
            out.append((start, end, "comment"))
        at = max(end, m.end())
    return out


@lru_cache(maxsize=4)
def blanked(text: str, language: str, kinds: tuple[str, ...] = ("comment", "string")) -> str:
    """Comments and strings as spaces; line breaks stay.  A string's quotes stay too."""
    out, at = [], 0
    for start, end, kind in spans(text, language):
        if kind in kinds:
            keep = 1 if kind == "string" else 0
            out += [text[at : start + keep], re.sub(r"[^\n]", " ", text[start + keep : max(end - keep, start + keep)])]
            at = max(end - keep, start + keep)
    return "".join(out) + text[at:]


# --- patterns --------------------------------------------------------------

_ID = r"[A-Za-z_$][\w$]*"
#: language -> (kind, pattern with a name group), tried line by line on blanked text.
DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "Python": [("Class", r"^\s*class\s+(?P<n>\w+)"), ("Function", r"^\s*(?:async\s+)?def\s+(?P<n>\w+)"), ("Const", r"^(?P<n>[A-Z][A-Z0-9_]+)\s*(?::[^=]+)?=")],
    "Go": [("Method", r"^func\s*\([^)]*\)\s*(?P<n>\w+)"), ("Function", r"^func\s+(?P<n>\w+)"), ("Interface", r"^type\s+(?P<n>\w+)(?:\[.*\])?\s+interface\b"), ("Struct", r"^type\s+(?P<n>\w+)(?:\[.*\])?\s+struct\b"), ("Type", r"^type\s+(?P<n>\w+)")],
    "Rust": [("Function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\S*\s*)*fn\s+(?P<n>\w+)"), ("Struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)"), ("Enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)"), ("Trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<n>\w+)"), ("Module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<n>\w+)\s*\{"), ("Const", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?P<n>[A-Z]\w*)"), ("Type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<n>\w+)")],
    "Java": [("Interface", r"^\s*(?:[\w@]+\s+)*interface\s+(?P<n>\w+)"), ("Enum", r"^\s*(?:[\w@]+\s+)*enum\s+(?P<n>\w+)"), ("Class", r"^\s*(?:[\w@]+\s+)*(?:class|record)\s+(?P<n>\w+)"), ("Method", r"^\s+(?:(?:public|protected|private|static|final|abstract|synchronized|default)\s+)*[\w<>\[\], ?.]+\s+(?P<n>\w+)\s*\([^;]*$")],
    "Kotlin": [("Interface", r"^\s*(?:\w+\s+)*interface\s+(?P<n>\w+)"), ("Class", r"^\s*(?:\w+\s+)*(?:class|object)\s+(?P<n>\w+)"), ("Function", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?(?P<n>\w+)\s*\(")],
    "Swift": [("Interface", r"^\s*(?:\w+\s+)*protocol\s+(?P<n>\w+)"), ("Struct", r"^\s*(?:\w+\s+)*struct\s+(?P<n>\w+)"), ("Enum", r"^\s*(?:\w+\s+)*enum\s+(?P<n>\w+)"), ("Class", r"^\s*(?:\w+\s+)*(?:class|actor)\s+(?P<n>(?!func\b)\w+)"), ("Function", r"^\s*(?:@?\w+\s+)*func\s+(?P<n>\w+)")],
    "Ruby": [("Module", r"^\s*module\s+(?P<n>[\w:]+)"), ("Class", r"^\s*class\s+(?P<n>[\w:]+)"), ("Method", r"^\s*def\s+(?:self\.)?(?P<n>[\w?!]+)")],
    "Lua": [("Function", r"^\s*(?:local\s+)?function\s+(?:[\w.]+[.:])?(?P<n>\w+)"), ("Function", r"^\s*(?:local\s+)?(?:[\w.]+\.)?(?P<n>\w+)\s*=\s*function\b")],
    "Shell": [("Function", r"^\s*@test\s+[\"'](?P<n>.*)[\"']\s*\{"), ("Function", r"^\s*(?:function\s+)?(?P<n>[\w:.-]+)\s*\(\)\s*\{?"), ("Function", r"^\s*function\s+(?P<n>[\w:.-]+)")],
    "Php": [("Interface", r"^\s*interface\s+(?P<n>\w+)"), ("Trait", r"^\s*trait\s+(?P<n>\w+)"), ("Class", r"^\s*(?:\w+\s+)*class\s+(?P<n>\w+)"), ("Function", r"^\s*(?:\w+\s+)*function\s+&?(?P<n>\w+)")],
    "Dart": [("Class", r"^\s*(?:abstract\s+|final\s+|base\s+)*(?:class|mixin)\s+(?P<n>\w+)"), ("Enum", r"^\s*enum\s+(?P<n>\w+)"), ("Function", r"^\s*(?:static\s+)?[\w<>?]+\s+(?P<n>\w+)\s*\([^;]*\)\s*(?:async\s*)?(?:\{|=>)")],
    "Proto": [("Struct", r"^\s*message\s+(?P<n>\w+)"), ("Enum", r"^\s*enum\s+(?P<n>\w+)"), ("Interface", r"^\s*service\s+(?P<n>\w+)"), ("Method", r"^\s*rpc\s+(?P<n>\w+)")],
    "VisualBasic": [("Class", r"(?i)^\s*(?:\w+\s+)*class\s+(?P<n>\w+)"), ("Module", r"(?i)^\s*(?:\w+\s+)*module\s+(?P<n>\w+)"), ("Interface", r"(?i)^\s*(?:\w+\s+)*interface\s+(?P<n>\w+)"), ("Method", r"(?i)^\s*(?:(?!end\b)\w+\s+)*(?:sub|function)\s+(?P<n>\w+)")],
}
_SCRIPT = [("Interface", rf"^\s*(?:export\s+)?(?:declare\s+)?interface\s+(?P<n>{_ID})"), ("Class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>{_ID})"), ("Enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<n>{_ID})"), ("Type", rf"^\s*(?:export\s+)?type\s+(?P<n>{_ID})\b[^=]*="), ("Function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>{_ID})"), ("Function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<n>{_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_ID})\s*(?::[^=]+)?=>"), ("Const", rf"^\s*(?:export\s+)?const\s+(?P<n>{_ID})\b")]
_CURLY = [("Struct", r"^\s*(?:typedef\s+)?(?:struct|union)\s+(?P<n>\w+)[^;()]*\{?\s*$"), ("Enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<n>\w+)"), ("Class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?P<n>\w+)[^;]*$"), ("Module", r"^\s*namespace\s+(?P<n>[\w:]+)"), ("Class", r"^\s*@(?:interface|implementation|protocol)\s+(?P<n>\w+)"), ("Method", r"^\s*[-+]\s*\([^)]*\)\s*(?P<n>\w+)"), ("Function", r"^(?!\s*(?:return|else|if|for|while|switch|typedef)\b)[\w:*&<>,\s]*?[\w*&>]\s+[*&]*(?:\w+::)*(?P<n>~?\w+)\s*\([^;]*$")]
_SHARP = [("Module", r"^\s*namespace\s+(?P<n>[\w.]+)"), ("Interface", r"^\s*(?:\w+\s+)*interface\s+(?P<n>\w+)"), ("Enum", r"^\s*(?:\w+\s+)*enum\s+(?P<n>\w+)"), ("Struct", r"^\s*(?:\w+\s+)*struct\s+(?P<n>\w+)"), ("Class", r"^\s*(?:\w+\s+)*(?:class|record)\s+(?P<n>\w+)"), ("Method", r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract)\s+)+[\w<>\[\],? .]+\s+(?P<n>\w+)\s*\(")]
DEFINITIONS |= {n: _SCRIPT for n in ("TypeScript", "Tsx", "JavaScript", "Vue")} | {n: _CURLY for n in ("C", "Cpp", "ObjC", "ObjCpp")} | {"CSharp": _SHARP}

#: language -> patterns with the specifier in the first group that took part, on text whose comments are blanked.
IMPORTS: dict[str, list[str]] = {
    "Python": [r"^\s*from\s+(\.*[\w.]*)\s+import\b", r"^\s*import\s+([\w.]+(?:\s*,\s*[\w.]+)*)"],
    "Go": [r'^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"', r'^\s+(?:[\w.]+\s+)?"([^"]+)"\s*$'],
    "Rust": [r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", r"^\s*(?:#\[path\s*=\s*\"[^\"]+\"\]\s*)?(?:pub(?:\([^)]*\))?\s+)?(mod\s+\w+)\s*;"],
    "Java": [r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"],
    "Kotlin": [r"^\s*import\s+([\w.]+(?:\.\*)?)"],
    "Swift": [r"^\s*(?:@\w+\s+)?import[ \t]+(?:\w+[ \t]+)?([\w.]+)"],
    "Ruby": [r"^\s*require\s+['\"]([^'\"]+)", r"^\s*require_relative\s+['\"]([^'\"]+)"],
    "Lua": [r"\brequire\s*\(?\s*['\"]([^'\"]+)"],
    "Shell": [r"^\s*(?:source|\.)\s+['\"]?([^\s'\";]+)"],
    "Php": [r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)"],
    "Dart": [r"^\s*(?:import|export|part)\s+['\"]([^'\"]+)"],
    "Proto": [r'^\s*import\s+(?:public\s+|weak\s+)?"([^"]+)"'],
    "CSharp": [r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;"],
    "VisualBasic": [r"(?i)^\s*imports\s+(?:\w+\s*=\s*)?([\w.]+)"],
}
IMPORTS |= {n: [r"(?:^|\s)(?:import|export)\b[^'\"]*?\bfrom\s*['\"]([^'\"]+)", r"^\s*import\s*['\"]([^'\"]+)", r"\b(?:require|import)\s*\(\s*['\"]([^'\"]+)"] for n in ("TypeScript", "Tsx", "JavaScript", "Vue")}
IMPORTS |= {n: [r'^\s*#\s*(?:include|import)\s*("[^"]+"|<[^>]+>)'] for n in ("C", "Cpp", "ObjC", "ObjCpp")}

_CALL = re.compile(rf"(?<![\w$])({_ID})\s*\(")
_NOT_CALLS = set("if for while switch return catch function def fn func class sizeof typeof match when elif and or not in lambda print await yield new with assert del except using lock import".split())
_INDENTED = {"Python"}
_WORD_END = {"Ruby", "Lua", "VisualBasic"}


@cache
def _rules(language: str) -> list[tuple[str, re.Pattern[str]]]:
    return [(kind, re.compile(p)) for kind, p in DEFINITIONS.get(language, [])]


@cache
def _specifiers(language: str) -> list[re.Pattern[str]]:
    return [re.compile(p, re.MULTILINE) for p in IMPORTS.get(language, [])]


def _end_line(lines: list[str], start: int, language: str) -> int:
    """The last line (1-based) of the definition that starts at line ``start``."""
    indent = len(lines[start - 1]) - len(lines[start - 1].lstrip())
    if language in _INDENTED:
        last = start
        for n in range(start, len(lines)):
            if lines[n].strip():
                if len(lines[n]) - len(lines[n].lstrip()) <= indent:
                    break
                last = n + 1
        return last
    if language in _WORD_END:
        for n in range(start, len(lines)):
            if re.match(r"(?i)\s*end\b", lines[n]) and len(lines[n]) - len(lines[n].lstrip()) == indent:
                return n + 1
        return start
    depth, opened = 0, False
    for n in range(start - 1, len(lines)):
        if not opened and not lines[n].strip():
            return start
        for c in lines[n]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
        if opened and depth <= 0:
            return n + 1
        if not opened and lines[n].rstrip().endswith(";"):
            return n + 1
    return start if not opened else len(lines)


def exported(language: str, name: str, line: str) -> bool:
    if language == "Go":
        return name[:1].isupper()
    if language in ("Python", "Dart", "Lua", "Shell", "Ruby"):
        return not name.startswith("_") and not re.match(r"\s*local\b", line)
    if language in ("TypeScript", "Tsx", "JavaScript", "Vue"):
        return bool(re.match(r"\s*export\b", line))
    if language == "Rust":
        return bool(re.match(r"\s*pub\b", line))
    if language in ("Java", "CSharp"):
        return bool(re.match(r"\s*(?:\w+\s+)*public\b", line))
    return not re.search(r"\b(private|static|fileprivate|internal)\b", line)


def symbols_of(language: str, text: str) -> list[tuple[str, str, str, int, int, bool]]:
    """(name, kind, signature, start_line, end_line, exported) in order of lines; one symbol a line."""
    code = blanked(text, language)
    lines, source, out = code.split("\n"), text.split("\n"), []
    rules = _rules(language)
    for n, line in enumerate(lines, 1):
        for kind, rule in rules if line and not line.isspace() else ():
            if m := rule.match(line):
                if kind == "Function" and language in ("Python", "Rust", "Php", "Kotlin", "Swift") and len(line) - len(line.lstrip()):
                    kind = "Method"
                name = source[n - 1][m.start("n") : m.end("n")]
                out.append((name, kind, " ".join(source[n - 1].split())[:200], n, _end_line(lines, n, language), exported(language, name, line)))
                break
    return out


def use_paths(tree: str) -> list[str]:
    """The paths of a use tree, braces expanded, in order; ``self`` in braces is the path before them, names after ``as`` and a
    final * fall away."""
    tree = " ".join(tree.split())
    at = tree.find("{")
    if at < 0:
        path = re.sub(r"\s+as\s+\w+$", "", tree.strip()).replace(" ", "")
        return [re.sub(r"::(\*|self)$", "", path)] if path not in ("", "*") else []
    out, depth, start, end = [], 0, at + 1, len(tree)
    for n in range(at, len(tree)):
        c = tree[n]
        depth += (c == "{") - (c == "}")
        if (c == "," and depth == 1) or (c == "}" and depth == 0):
            out += [p for p in use_paths(tree[:at] + tree[start:n]) if tree[start:n].strip()]
            start = n + 1
        if c == "}" and depth == 0:
            break
    return list(dict.fromkeys(out))


def imports_of(language: str, text: str) -> list[str]:
    code, found = blanked(text, language, ("comment",)), []
    for p in _specifiers(language):
        for m in p.finditer(code):
            spec = m[1].strip()
            if language == "Ruby" and "require_relative" in m[0]:
                spec = f"relative:{spec}"
            specs = [s.strip() for s in spec.split(",")] if language == "Python" else [spec]
            if language == "Rust":
                named = re.search(r'#\[path\s*=\s*"([^"]+)"', m[0])
                specs = [re.sub(r"^mod\s+", "mod ", spec) + (f" = {named[1]}" if named else "")] if re.match(r"mod\s", spec) else use_paths(spec)
            found += [(m.start(), s) for s in specs if s]
    return [s for _, s in sorted(found)]


def calls_of(language: str, text: str) -> list[tuple[str, int]]:
    """(callee, line) of each name before a bracket, definitions left out."""
    out = []
    rules = _rules(language)
    for n, line in enumerate(blanked(text, language).split("\n"), 1):
        if "(" in line and (found := [name for name in _CALL.findall(line) if name not in _NOT_CALLS]):
            defined = next((m["n"] for _, r in rules if (m := r.match(line))), None)
            out += [(name, n) for name in found if name != defined]
    return out


PARSED = "path string, language string, partial boolean, symbols array<struct<name:string,kind:string,signature:string,start_line:int,end_line:int,exported:boolean>>, imports array<string>, calls array<struct<callee:string,line:int>>"


_SYMBOL = pa.struct([("name", pa.string()), ("kind", pa.string()), ("signature", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("exported", pa.bool_())])
_CALLEE = pa.struct([("callee", pa.string()), ("line", pa.int32())])
_PARSED = pa.schema([("path", pa.string()), ("language", pa.string()), ("partial", pa.bool_()), ("symbols", pa.list_(_SYMBOL)), ("imports", pa.list_(pa.string())), ("calls", pa.list_(_CALLEE))])


def parse(path: str, language: str, text: str, named: bool = True, called: bool = True) -> tuple[list[tuple], list[str], list[tuple[str, int]]]:
    """Symbols (if ``named``), imports and calls (if ``called``) of one file, over all its readings; what two readings share is
    given once.  A component is a module itself, its script's names are exported, and its template calls."""
    from .prepare import component, prepared, template_calls

    symbols, imports, calls = [], [], []
    if not (text or language == "Vue"):
        return symbols, imports, calls
    vue = language == "Vue"
    if vue:
        symbols.append((component(path), "Module", f"vue SFC {component(path)}", 1, max(1, len(text.splitlines())), True))
        calls += template_calls(text)
    for inner, reading in prepared(path, language, text):
        known = {(s[0], s[3]) for s in symbols}, set(imports), set(calls)
        symbols += [(*s[:5], True) if vue else s for s in (symbols_of(inner, reading) if named else ()) if (s[0], s[3]) not in known[0]]
        imports += [i for i in imports_of(inner, reading) if i not in known[1]]
        calls += [c for c in (calls_of(inner, reading) if called else ()) if c not in known[2]]
    return sorted(symbols, key=lambda s: s[3]), imports, calls


def parsed(files: DataFrame, calls: bool = True, symbols: tuple[str, ...] | None = None) -> DataFrame:
    """files: path, language, text.  One row a file; ``explode`` its lists for the tables of symbols, imports, calls.  Who needs
    no ``calls``, or ``symbols`` of some languages only, has empty lists for the rest, which is then not sought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows.append((path, language, False, *parse(path or "", language, text or "", symbols is None or language in symbols, calls)))
                except (RecursionError, re.error, ValueError):
                    rows.append((path, language, True, [], [], []))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARSED.types, strict=True)], schema=_PARSED)

    bounded_batches(files.sparkSession)
    return files.select("path", "language", "text").mapInArrow(run, PARSED)


def reparsed(before: DataFrame, files: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored parses (as of ``parsed``) after changes (path, and kind: created, modified or removed): only files that were
    created or modified are read again, and rows of every changed path go.  A changed file that is not there any more
    has none; a path that stands in several changes is read once."""
    touched = changes.select("path").distinct()
    fresh = files.join(changes.filter("kind != 'removed'").select("path").distinct(), "path", "left_semi")
    return before.join(touched, "path", "left_anti").unionByName(parsed(fresh))


def diagnosed(files: DataFrame) -> DataFrame:
    """path, line, what, class of the files that cannot be read whole, one row each: their first place of error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .prepare import diagnosis

        for batch in batches:
            found = [(path, diagnosis(language, text or "")) for path, language, text in zip(batch["path"], batch["language"], batch["text"], strict=True)]
            yield pd.DataFrame([(path, *d) for path, d in found if d], columns=["path", "line", "what", "class"])

    bounded_batches(files.sparkSession)
    return files.select("path", "language", "text").mapInPandas(run, "path string, line int, what string, class string")


def masked_lines(files: DataFrame) -> DataFrame:
    """path, line_no, line with comments and strings blanked; languages without a lexer come back as they are, lexed
    false."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, text in zip(batch["path"], batch["language"], batch["text"], strict=True):
                rows += [(path, n, line, language in LEXERS) for n, line in enumerate(blanked(text or "", language).split("\n"), 1)]
            yield pd.DataFrame(rows, columns=["path", "line_no", "line", "lexed"])

    return files.select("path", "language", "text").mapInPandas(run, "path string, line_no int, line string, lexed boolean")


_COUNT_OPEN, _COUNT_CLOSE = set("([{"), set(")]}")


def method_key(name: str, signature: str) -> tuple[str, int | None, int | None]:
    """(name, parameters, results) of ``name(params) results``; None where the signature does not tell."""

    def parts(inner: str) -> int:
        depth, n = 0, 1
        for c in inner:
            depth += (c in _COUNT_OPEN) - (c in _COUNT_CLOSE)
            n += c == "," and depth == 0
        return n if inner.strip().rstrip(",").strip() else 0

    at = signature.find(f"{name}(")
    if at < 0 or signature.endswith("…"):
        return name, None, None
    depth, start = 0, at + len(name)
    for end in range(start, len(signature)):
        depth += (signature[end] in _COUNT_OPEN) - (signature[end] in _COUNT_CLOSE)
        if not depth:
            rest = re.sub(r"//.*", "", signature[end + 1 :]).strip().rstrip("{").strip()
            results = 0 if not rest else parts(rest[1:-1]) if rest.startswith("(") and rest.endswith(")") else 1
            return name, parts(signature[start + 1 : end].rstrip().rstrip(",")), results
    return name, None, None
