"""Text that is made ready for extraction: parts that are no code of the language become spaces, every line stays where it is.

``prepared`` gives one or two readings of a file; two where conditional compilation has branches, the first and the last
that could be compiled.  ``diagnosis`` names the first place where a text cannot be read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from posixpath import basename

from .extract import blanked, spans

_SCRIPTS = {"ts": "TypeScript", "typescript": "TypeScript", "tsx": "Tsx", "jsx": "Tsx"}


def _spaces(text: str) -> str:
    return re.sub(r"[^\r\n]", " ", text) if "\n" in text or "\r" in text else " " * len(text)


def _kept(text: str, keep: list[tuple[int, int]]) -> str:
    """Spaces for all but the ranges, which are in order and apart."""
    out, at = [], 0
    for start, end in keep:
        out += [_spaces(text[at:start]), text[start:end]]
        at = end
    return "".join(out) + _spaces(text[at:])


# --- conditional compilation -------------------------------------------------


@dataclass
class _Branches:
    """One conditional that is open: whether what holds it is read, its number, the branch that is being read."""

    outer: bool
    number: int
    branch: int = 0


_DIRECTIVE = re.compile(r"(?i)^\s*#\s*(if|ifdef|ifndef|elif|elifdef|elifndef|elseif|else|endif|end\s+if)\b(.*)$")


def _possible(condition: str) -> bool:
    """False only for a condition that is literally false."""
    bare = re.sub(r"//.*|/\*.*?\*/|(?i:\bthen\b)|[()\s]", "", condition)
    return bare.lower() not in ("0", "false", "!1", "!true")


def branches(text: str, language: str = "CSharp") -> list[str]:
    """The readings of a text with conditional directives: with the first possible branch of each conditional, and with the
    last one if that differs.  Directive lines become spaces.  A text without conditionals is its only reading."""
    if "#" not in text:
        return [text]
    lines, possible, stack, where = text.split("\n"), [], [], []
    code = blanked(text, language).split("\n") if language == "VisualBasic" else lines
    for line in code:
        m = _DIRECTIVE.match(line)
        word = re.sub(r"\s+", "", m[1].lower()) if m else ""
        if word in ("if", "ifdef", "ifndef"):
            stack.append(_Branches(True, len(possible)))
            possible.append([0] if word != "if" or _possible(m[2]) else [])
        elif word in ("else", "elif", "elseif", "elifdef", "elifndef") and stack:
            stack[-1].branch += 1
            if word not in ("elif", "elseif") or _possible(m[2]):
                possible[stack[-1].number].append(stack[-1].branch)
        elif word == "endif" and stack:
            stack.pop()
        where.append((word, [(b.number, b.branch) for b in stack]))
    if not possible:
        return [text]

    def reading(choice: dict[int, int | None]) -> str:
        return "\n".join(_spaces(line) if word or any(choice[n] != b for n, b in at) else line for line, (word, at) in zip(lines, where, strict=True))

    first = reading({n: p[0] if p else None for n, p in enumerate(possible)})
    last = reading({n: p[-1] if p else None for n, p in enumerate(possible)})
    return [first] if first == last else [first, last]


# --- languages ---------------------------------------------------------------


def c_family(text: str) -> str:
    """Without macro definitions, with test macros and export macros that leave the name of what they stand before."""
    text = re.sub(r"(?m)^[ \t]*#[ \t]*(?:define|undef|pragma|error|warning|line)\b(?:[^\n]*\\\r?\n)*[^\n]*", lambda m: _spaces(m[0]), text)
    text = re.sub(r"\b((?:class|struct|enum class|enum|union)[ \t]+)([A-Z][A-Z0-9_]*_[A-Z0-9_]*(?:\([^()\n]*\))?)(?=[ \t]+\w)", lambda m: m[1] + _spaces(m[2]), text)
    text = re.sub(r"(?m)^([ \t]*(?:TEST_CASE|SCENARIO)\()([^\n]*)(\)\s*\{)", lambda m: f"void {m[1].lstrip()}{_spaces(m[2])}{m[3]}", text)
    return re.sub(r"__attribute__\s*\(\((?:[^()]|\([^()]*\))*\)\)|\b__declspec\s*\([^()]*\)", lambda m: _spaces(m[0]), text)


#: Words of Objective-C that stand alone on a line, and those that take brackets; fixed values of its public headers.
_OBJC_ALONE = r"\b(?:NS_ASSUME_NONNULL_BEGIN|NS_ASSUME_NONNULL_END|NS_REQUIRES_SUPER|NS_DESIGNATED_INITIALIZER|NS_UNAVAILABLE|UI_APPEARANCE_SELECTOR|IBInspectable|IB_DESIGNABLE)\b"
_OBJC_CALL = r"\b(?:NS_SWIFT_NAME|NS_SWIFT_UNAVAILABLE|NS_AVAILABLE|NS_AVAILABLE_IOS|NS_DEPRECATED|API_AVAILABLE|API_DEPRECATED|API_UNAVAILABLE)\s*\((?:[^()]|\([^()]*\))*\)"


def objc(text: str) -> str:
    text = re.sub(f"{_OBJC_ALONE}|{_OBJC_CALL}", lambda m: _spaces(m[0]), c_family(text))
    return re.sub(r"\b(typedef\s+)?NS_(?:ENUM|OPTIONS|CLOSED_ENUM)\s*\(\s*\w+\s*,\s*(\w+)\s*\)", lambda m: f"{m[1] or ''}enum {m[2]}", text)


def _closing(code: str, start: int) -> int:
    """The place after the bracket that closes the brace at start; the end if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def razor(text: str) -> str:
    """C# of a page: the insides of @code blocks and @{ } blocks, and @using lines as statements."""
    text = re.sub(r"@\*.*?\*@", lambda m: _spaces(m[0]), text, flags=re.DOTALL)
    text = re.sub(r"(?m)^([ \t]*)@(using[ \t]+[\w.= ]+?)[ \t]*;?(\r?)$", lambda m: f"{m[1]}{m[2]};{m[3]}", text)
    keep = [(m.start(), m.end()) for m in re.finditer(r"(?m)^[ \t]*using [\w.= ]+;", text)]
    at = 0
    for m in re.finditer(r"(?<!@)@(?:code\b\s*)?\{", text):
        if m.start() >= at:
            end = _closing(blanked(text[m.start() :], "CSharp"), m.end() - 1 - m.start()) + m.start()
            keep.append((m.end(), max(m.end(), end - 1)))
            at = end
    out, last = [], 0
    for start, end in sorted(keep):
        if start >= last:
            out.append((start, end))
            last = end
    return _kept(text, out)


def script_blocks(text: str) -> list[tuple[str, str]]:
    """(language, text) of a component's script blocks, each alone in a text as long as the file; marks in comments of the
    markup count for nothing."""
    bare = re.sub(r"<!--.*?-->", lambda m: _spaces(m[0]), text, flags=re.DOTALL)
    out = []
    for m in re.finditer(r"(?is)<script\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)</script\s*>", bare):
        named = re.search(r"""\blang\s*=\s*["']?(\w+)""", m[1])
        out.append((_SCRIPTS.get(named[1].lower() if named else "", "JavaScript"), _kept(text, [(m.start(2), m.end(2))])))
    return out


_NAME = r"[A-Za-z_$][\w$]*"


def template_calls(text: str) -> list[tuple[str, int]]:
    """(callee, line) in a component's template: calls in {{ }} and in bound attributes, handlers named without brackets, and
    components by their tag."""
    bare = re.sub(r"<!--.*?-->", lambda m: _spaces(m[0]), text, flags=re.DOTALL)
    found = []
    for block in re.finditer(r"(?is)<template\b[^>]*>(.*)</template\s*>", bare):
        inner, start = block[1], block.start(1)
        pieces = [(m.start(1), m[1], False) for m in re.finditer(r"\{\{(.*?)\}\}", inner, re.DOTALL)]
        pieces += [(m.start(2), m[2], m[1][0] == "@" or m[1].startswith("v-on")) for m in re.finditer(r"""(?<=\s)((?:@|:|v-)[\w:.\-]*)\s*=\s*"([^"]*)\"""", inner)]
        for at, code, handler in pieces:
            if handler and re.fullmatch(rf"\s*{_NAME}\s*", code):
                found.append((start + at, code.strip()))
            found += [(start + at + m.start(1), m[1]) for m in re.finditer(rf"(?<![\w$])({_NAME})\s*\(", code) if m[1] not in ("if", "for", "while", "switch", "function", "return")]
        found += [(start + m.start(1), m[1]) for m in re.finditer(r"<([A-Z][A-Za-z0-9]*)\b", inner)]
    return [(name, text.count("\n", 0, at) + 1) for at, name in sorted(found)]


def shell(text: str) -> str:
    """Bodies of here-documents become spaces; zsh's functions of several names become one of the first."""
    lines, out, ends = text.split("\n"), [], []
    for line in lines:
        if ends:
            word, tabs = ends[0]
            if (line.lstrip("\t") if tabs else line).rstrip("\r") == word:
                ends.pop(0)
            out.append(_spaces(line))
            continue
        bare = re.sub(r"(^|\s)#.*$", lambda m: _spaces(m[0]), line)
        for m in re.finditer(r"(?<!<)<<(-?)\s*(?:'([^']+)'|\"([^\"]+)\"|\\?([A-Za-z_]\w*))", bare):
            if "((" not in bare[: m.start()]:
                ends.append((m[2] or m[3] or m[4], bool(m[1])))
        line = re.sub(r"^(\s*function\s+[\w:.-]+)((?:\s+[\w:.-]+)+)(\s*(?:\(\))?\s*\{)", lambda m: m[1] + _spaces(m[2]) + m[3], line)
        out.append(line)
    return "\n".join(out)


def prepared(path: str, language: str, text: str) -> list[tuple[str, str]]:
    """(language, text) to extract from; all as many lines as the file."""
    if language == "Vue" or path.endswith(".vue"):
        return script_blocks(text)
    if language == "CSharp":
        return [(language, t) for t in branches(razor(text) if re.search(r"\.(razor|cshtml)$", path) else text)]
    if language == "VisualBasic":
        return [(language, t) for t in branches(text, language)]
    if language in ("C", "Cpp"):
        return [(language, c_family(t)) for t in branches(text)]
    if language in ("ObjC", "ObjCpp"):
        return [(language, objc(t)) for t in branches(text)]
    if language == "Shell":
        return [(language, shell(text))]
    return [(language, text)]


def component(path: str) -> str:
    return basename(path).removesuffix(".vue") or "Component"


# --- diagnosis -----------------------------------------------------------------

_MACRO = re.compile(r"\b[A-Z][A-Z0-9]*_[A-Z0-9_]*\b|\b[A-Z]{4,}\s*\(")


def diagnosis(language: str, text: str) -> tuple[int, str, str] | None:
    """(line, what, macro or other) of the first bracket that closes nothing or another one, or else of the innermost one that
    stays open, in text whose comments and strings are blanked; None if all close.  In the C family a place is of class macro
    if a directive or a macro's name stands between the open bracket before it and the second line after it."""
    code, stack, pairs, place = blanked(text, language), [], {")": "(", "]": "[", "}": "{"}, None
    if not spans("'", language) and not spans('"', language):
        return None
    for m in re.finditer(r"[()\[\]{}]", code):
        if m[0] in pairs:
            if not stack or stack[-1][0] != pairs[m[0]]:
                place = (m.start(), f"unexpected {m[0]}")
                break
            stack.pop()
        else:
            stack.append((m[0], m.start()))
    if place is None and stack:
        place = (stack[-1][1], f"{stack[-1][0]} is not closed")
    if place is None:
        return None
    line = code.count("\n", 0, place[0]) + 1
    begin = code.count("\n", 0, stack[-1][1]) if stack else line - 1
    near = code.split("\n")[begin : line + 2]
    macro = language in ("C", "Cpp", "ObjC", "ObjCpp") and (bool(_MACRO.search("\n".join(near))) or any(re.match(r"\s*#", x) for x in near))
    return line, place[1], "macro" if macro else "other"
