"""Words, names, paths, globs and lines as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a query that say nothing.
STOP_WORDS = ("a", "an", "and", "by", "for", "from", "in", "into", "is", "of", "on", "or", "the", "to", "with")
#: Words of a task description that say nothing.
TASK_STOP_WORDS = (
    "the how does what where when which that this with from into "
    "and for are was not all any can should would could there "
    "their about have has been will you why who get set use "
    "add make new fix need want work works code file files"
).split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- words -----------------------------------------------------------------


def word_list(x: Column | str) -> Column:
    """Sub-words in order, lower case: split at other characters, aB, 1B and ABc boundaries."""
    apart = F.regexp_replace(_c(x), r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    apart = F.regexp_replace(apart, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(apart), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def split_words(x: Column | str) -> Column:
    """The set of sub-words, sorted."""
    return F.array_sort(F.array_distinct(word_list(x)))


def name_tokens(x: Column | str) -> Column:
    """Sub-words in order without the rule for acronyms."""
    apart = F.regexp_replace(_c(x), r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    return F.filter(F.split(F.lower(apart), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stem(w: Column) -> Column:
    """Light plural folding; lengths are bytes."""
    n = F.octet_length(w)
    plural = w.endswith("s") & ~w.endswith("ss") & ~w.rlike(r"[^\x00-\x7F]")
    return F.when((n > 4) & w.endswith("ies"), F.concat(F.substr(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when((n > 3) & plural, F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def words_of(x: Column | str) -> Column:
    """Sub-words without stop words, stemmed, sorted, each once."""
    kept = F.filter(split_words(x), lambda w: ~w.isin(*STOP_WORDS))
    return F.array_sort(F.array_distinct(F.transform(kept, stem)))


def compact_lower(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(x), r"[^\p{L}\p{N}]", ""))


def test_base(stem_: Column | str) -> Column:
    """quiet_test, quiettest and test_quiet give quiet; other names give null."""
    s = _c(stem_)
    base = F.when(s.endswith("_test"), F.regexp_replace(s, "_test$", "")).when(s.endswith("test"), F.regexp_replace(s, "test$", "")).when(s.startswith("test_"), F.regexp_replace(s, "^test_", ""))
    return F.when(base != "", base)


# --- paths -----------------------------------------------------------------


def norm_path(x: Column | str) -> Column:
    """Forward slashes, without the Windows long-path mark and leading ./ or /."""
    p = F.regexp_replace(_c(x), r"^\\\\\?\\", "")
    return F.regexp_replace(F.translate(p, "\\", "/"), r"^(\./|/)+", "")


def dir_of(x: Column | str) -> Column:
    return F.regexp_extract(_c(x), r"^(.*)/[^/]*$", 1)


def base_of(x: Column | str) -> Column:
    return F.regexp_extract(_c(x), r"([^/]*)$", 1)


def ext_of(x: Column | str) -> Column:
    return F.lower(F.regexp_extract(base_of(x), r"[^.]\.([^.]+)$", 1))


def stem_of(x: Column | str) -> Column:
    return F.regexp_replace(base_of(x), r"(?<=[^.])\.[^.]*$", "")


def top_of(x: Column | str) -> Column:
    """First segment; files at the root have '.'."""
    p = _c(x)
    return F.when(p.contains("/"), F.element_at(F.split(p, "/"), 1)).otherwise(".")


def two_segments(x: Column | str) -> Column:
    """First two directories."""
    d = dir_of(x)
    return F.when(d == "", ".").otherwise(F.array_join(F.slice(F.split(d, "/"), 1, 2), "/"))


def ancestors(directory: Column | str) -> Column:
    """The directory and all above it; the root, '', comes last."""
    d = _c(directory)
    parts = F.split(d, "/")
    return F.when(d == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def shared_segments(a: Column | str, b: Column | str) -> Column:
    """How many leading directories two paths share."""
    x, y = F.split(dir_of(a), "/"), F.split(dir_of(b), "/")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    fold = F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, e: F.struct((s["on"] & e).alias("on"), (s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n")))
    return F.when((dir_of(a) == "") | (dir_of(b) == ""), 0).otherwise(fold["n"])


def mentions_path(text: Column | str, path: Column | str) -> Column:
    """The path occurs in the text with no letter, digit, _ or - on either side; case does not count."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_-])\Q"), F.lower(_c(path)), F.lit(r"\E(?![\p{L}\p{N}_-])"))
    return (F.length(_c(path)) > 0) & F.regexp_like(F.lower(_c(text)), quoted)


def is_test_path(x: Column | str) -> Column:
    """A file that a broad listing puts last: tests, mocks and fixtures, documents, examples, scripts, vendored code."""
    return _c(x).rlike(r"(?i)test|spec|mock|fixture|__snapshots__|e2e|(^|/)(docs?|examples?|scripts|vendor|third_party)/|(^|/)probe")


def is_test_caller(path: Column | str, caller: Column | str) -> Column:
    """Test code by its file or by the caller's name."""
    by_file = _c(path).rlike(r"(?i)(_test|\.test|\.spec)\.[^/]*$|(^|/)test_[^/]*$|(^|/)tests?/|__tests__/")
    return by_file | _c(caller).rlike(r"^(Test|test_|Benchmark)")


def is_doc_path(x: Column | str) -> Column:
    """Prose: by extension, by a docs directory, or a .txt of a customary name."""
    return _c(x).rlike(r"(?i)\.(md|mdx|rst|adoc)$|(^|/)docs?/|(^|/)(readme|notes|changelog|changes|license|authors|todo|contributing|history|news|install)(\.[^/]*)?\.txt$")


#: Extensions and directories of test data.
DATA_EXTENSIONS = "json jsonl yaml yml toml csv tsv xml txt golden snap ini proto hex".split()
DATA_DIRS = "test tests testdata fixtures fixture vectors golden snapshots __snapshots__ spec data testvectors".split()


def is_data_fixture(x: Column | str) -> Column:
    """A data file in a directory of test data."""
    p = F.lower(_c(x))
    ext = F.regexp_extract(p, r"\.([^.]*)$", 1)
    return ext.isin(DATA_EXTENSIONS) & F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, DATA_DIRS)))


# --- patterns (made on the driver) -----------------------------------------


def glob_regex(glob: str, exclude: bool = False) -> str:
    """An anchored Java regex.  Globs match at any depth and * crosses slashes.  Exclude globs also take all that lies
    below a match, include globs only if they are bare names; a bare exclude that starts with _ . or - also matches the
    end of a file name."""
    base = glob.strip().removeprefix("./").rstrip("/")
    out, at = "", 0
    while at < len(base):
        if base.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
            continue
        c = base[at]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c in "{}":
            out += "(?:" if c == "{" else ")"
        elif c == "," and out.count("(?:") > out.count(")"):
            out += "|"
        else:
            out += re.escape(c)
        at += 1
    bare = not re.search(r"[/*?\[]", base)
    below = "(?:/.*)?" if exclude or bare else ""
    tail = f"|.*{out}" if exclude and bare and base[:1] in ("_", ".", "-") else ""
    return f"^(?:(?:.*/)?{out}{below}{tail})$"


def smart_case(query: str, regex: bool = False, case_sensitive: bool | None = None) -> bool:
    """Whether a search minds case: as asked, else for a regex or a query with an upper-case letter."""
    return case_sensitive if case_sensitive is not None else regex or any(c.isupper() for c in query)


def line_matcher(query: str, regex: bool = False, case_sensitive: bool | None = None):
    """A predicate on a text column.  Patterns that could match a line break are refused."""
    if regex and re.search(r"(?<!\\)(\\\\)*\\n|\n", query):
        raise ValueError("a pattern matches within one line")
    minds = smart_case(query, regex, case_sensitive)
    if not regex:
        return (lambda c: c.contains(query)) if minds else (lambda c: F.lower(c).contains(query.lower()))
    return lambda c: c.rlike(query if minds else f"(?i){query}")


def word_regex(name: str) -> str:
    """Java regex of a whole identifier."""
    return rf"(?<![\p{{L}}\p{{N}}_]){re.escape(name)}(?![\p{{L}}\p{{N}}_])"


# --- lines -----------------------------------------------------------------


def lines_of(text: Column | str) -> Column:
    """Lines without their ends; no empty line after a final line break."""
    return F.split(F.regexp_replace(_c(text), r"\r?\n\z", ""), r"\r?\n")


def loc(text: Column | str) -> Column:
    return F.when(_c(text) == "", 0).otherwise(F.size(lines_of(text)))


def token_estimate(chars: Column | str) -> Column:
    return F.ceil(_c(chars) / 4).cast("bigint")


def clip_line(line: Column | str, at: Column, match_length: int, most: int = 250, around: int = 90, shown: int = 40) -> Column:
    """Lines over ``most`` characters keep ``around`` on each side of the match (1-based), cut ends marked."""
    x, n = _c(line), F.length(_c(line))
    begin = F.greatest(F.lit(1), at - around)
    end = F.least(n, at + min(match_length, shown) - 1 + around)
    cut = F.concat(F.when(begin > 1, "…").otherwise(""), F.substr(x, begin, end - begin + 1), F.when(end < n, "…").otherwise(""))
    return F.when(n <= most, x).otherwise(cut)


def one_line(x: Column | str, most: int = 120) -> Column:
    """White space collapsed, cut at ``most`` characters."""
    s = F.trim(F.regexp_replace(_c(x), r"\s+", " "))
    return F.when(F.length(s) > most, F.concat(F.substr(s, F.lit(1), F.lit(most - 1)), F.lit("…"))).otherwise(s)


def anchor(signature: Column | str, path: Column | str, line: Column | str) -> Column:
    return F.concat(one_line(signature), F.lit("  @"), _c(path), F.lit(":"), _c(line).cast("string"))


_MODIFIERS = r"(pub\(crate\)|pub|export|default|async|public|private|protected|static|final|abstract|unsafe)"
_DEFINES = r"(fn|func|def|function|class|struct|enum|trait|interface|type|impl|const|let|var|mod|module)"


def is_definition_line(line: Column | str) -> Column:
    """The line declares something, behind any modifiers."""
    return _c(line).rlike(rf"^\s*({_MODIFIERS}\s+)*{_DEFINES} ")


def is_comment_line(line: Column | str) -> Column:
    """The line is a comment and nothing else."""
    return _c(line).rlike(r"^\s*(//|/\*|\*/|<!--|--|\"\"\"|\*( |$)|#( |#|!|$))")


def _begins_word(keys: list[str]) -> str:
    """A Java regex: a key that starts with a letter stands at a word's or a camel hump's start, others stand anywhere."""
    quote = lambda k: re.escape(k).replace("\\ ", " ")
    words = "|".join(quote(k) for k in keys if k[0].isalnum())
    signs = "|".join(quote(k) for k in keys if not k[0].isalnum())
    at_word = rf"(?:(?<![A-Za-z0-9])|(?<=[a-z])(?=[A-Z]))(?i:{words})" if words else ""
    return "|".join(x for x in (at_word, f"(?i:{signs})" if signs else "") if x)


#: Beginnings of words that tell a hit's role.
ASSERTS = ["assert", "expect", "require.", "require(", "want", "equal", "eq!(", "should", "tobe", "toequal", "t.error", "t.fatal", "== ", "!= ", "verify("]
LOADS = ["load", "read", "open", "getenv", "environ", "env::var", "lookup", "parse", "config", "fetch", "get(", ".get ", "unmarshal", "decode", "from_str", "require(", "import "]
BINDS = ["const ", "static ", "#define", " := ", "let ", "var "]
LITERALS = ["= \"", "=\"", ": \""]


def hit_role(line: Column | str, test: Column | bool = False, masked: Column | str | None = None) -> Column:
    """What the line of a hit is: comment; assert or ref in tests; def, load or use elsewhere.  ``masked``: the line with
    its strings blanked, where words are looked for; literals are looked for in the line itself."""
    x = _c(line) if masked is None else _c(masked)
    test = F.lit(test) if isinstance(test, bool) else test
    return (
        F.when(is_comment_line(x), "comment")
        .when(test, F.when(x.rlike(_begins_word(ASSERTS)), "assert").otherwise("ref"))
        .when(is_definition_line(x), "def")
        .when(x.rlike(_begins_word(LOADS)), "load")
        .when(x.rlike(_begins_word(BINDS)) | _c(line).rlike(_begins_word(LITERALS)), "def")
        .otherwise("use")
    )


#: Words beside "count" that make it a verb.
COUNT_LEADS = "to and then please just also can you i we need want should must".split()
COUNT_TAILS = "of the all how each every occurrences usages calls lines files matches per by in total".split()


def task_class(task: Column | str) -> Column:
    """refs, count, rename or other, by what a task asks for; "count" counts as a verb only."""
    t = F.lower(_c(task))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^a-z0-9_]+", " ")), F.lit(" "))
    counting = rf"^ count(s|ing)? | ({'|'.join(COUNT_LEADS)}) count(s|ing)? | count(s|ing)? ({'|'.join(COUNT_TAILS)}) "
    return (
        F.when(words.rlike(" (callers?|usages?|references|who calls|called by) ") | t.rlike("谁调用|调用方|引用"), "refs")
        .when(words.rlike(f"{counting}| (how many|number of) ") | t.rlike("多少|统计|每个目录|分布|调用次数"), "count")
        .when(words.rlike(" (rename|renaming) ") | t.rlike("重命名|改名|批量改|替换"), "rename")
        .otherwise("other")
    )


# --- queries ---------------------------------------------------------------


def looks_like_regex(query: Column | str) -> Column:
    q, n = _c(query), F.length(_c(query))
    inside = q.rlike(r"\||\.\*|\.\+|\\[bsdw]|\(\?")
    return inside | (q.startswith("^") & (n > 1)) | (q.endswith("$") & (n > 1) & ~q.endswith("\\$"))


def looks_like_code(query: Column | str) -> Column:
    """A call or a signature, not a regex: an identifier before the first parenthesis, or an arrow or block after one."""
    q = _c(query)
    starts = q.startswith("(") & q.rlike(r"=>|\) ?\{")
    called = q.rlike(r"^[^(]*[\p{L}\p{N}_]\s*\(")
    return ~looks_like_regex(q) & ~q.rlike(r"\\[()]") & q.contains("(") & (starts | (~q.startswith("(") & called))


#: Extensions of code.
CODE_EXTENSIONS = "al c clj cljs cpp cs cshtml csx dart elm ex exs fs fsx go groovy h hpp hs java jl js jsx kt kts lean lua m matlab nf php proto py r razor rb rs scala sol svelte swift ts tsx vb vue zig".split()


def looks_like_path(query: Column | str) -> Column:
    """A path of a file system rather than a symbol: absolute with another separator, a drive, a home, a backslash, a
    trailing slash, or a last segment with an extension of code."""
    q = F.regexp_replace(F.trim(_c(query)), r"^(\./)+", "")
    code = F.lower(F.regexp_extract(F.regexp_extract(q, r"([^/]*)$", 1), r"\.([A-Za-z0-9]+)$", 1)).isin(CODE_EXTENSIONS)
    rooted = q.rlike(r"^[/\\]")
    rest = F.substring(q, 2, 1 << 20)
    absolute = (rest != "") & (rest.rlike(r"[/\\]") | q.endswith("/") | code)
    return (q != "") & (q != "*") & F.when(rooted, absolute).otherwise(q.rlike(r"^~[/\\]|^[A-Za-z]:[/\\]|\\|/$") | code)


#: Words of declarations that people put before a name.
QUERY_KEYWORDS = "struct class func fn def function method interface enum trait type impl record".split()


def symbol_query(raw: Column | str) -> Column:
    """A name as people write it, as a name path: words of declarations go, unless nothing else is left; ``::`` and ``.``
    become ``/``, and a leading ``::`` anchors at the top."""
    tokens = F.filter(F.split(_c(raw), r"\s+"), lambda t: t != "")
    named = F.filter(tokens, lambda t: ~F.lower(t).isin(QUERY_KEYWORDS))
    kept = F.array_join(F.when((F.size(tokens) > 1) & (F.size(named) > 0), named).otherwise(tokens), " ")
    parts = F.filter(F.split(kept, r"::|\."), lambda t: t != "")
    path = F.concat(F.when(kept.startswith("::"), "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(~kept.contains("/") & (F.size(parts) > 1), path).otherwise(kept)


def utf16_column(line: Column | str, characters: Column) -> Column:
    """The column in UTF-16 units of the place behind so many characters of the line."""
    head = F.substr(_c(line), F.lit(1), characters)
    return F.length(head) + F.regexp_count(head, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def decorated(line: Column | str, kind: Column | str, container: Column | str, signature: Column | str, most: int = 24) -> Column:
    """The line with ``[kind in container]``; a kind that the signature starts with is not said again, and long container
    names are cut."""
    kind, holder = F.lower(_c(kind)), _c(container)
    obvious = F.regexp_like(F.lower(F.ltrim(_c(signature))), F.concat(F.lit("^"), kind, F.lit(r"\s")))
    short = F.when(F.length(holder) > most, F.concat(F.substr(holder, F.lit(1), F.lit(most - 1)), F.lit("…"))).otherwise(holder)
    said = F.when(obvious & holder.isNull(), "").when(obvious, F.concat(F.lit("  [in "), short, F.lit("]"))).when(holder.isNull(), F.concat(F.lit("  ["), kind, F.lit("]")))
    return F.concat(_c(line), F.coalesce(said, F.concat(F.lit("  ["), kind, F.lit(" in "), short, F.lit("]"))))


#: From the worst.
SEVERITIES = ("error", "warning", "information", "hint")


def at_least(severity: Column | str, floor: str) -> Column:
    """The severity is the floor's or a worse one; unknown ones are none."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES[: SEVERITIES.index(floor) + 1])), F.lower(_c(severity))) > 0


CONFIDENCE_NOTES = {
    "Exact": "checked by a language server",
    "Scoped": "from the index, within the importing files",
    "Syntactic": "matched by name only",
    "Unknown": "not checked",
}


def confidence_note(c: Column | str) -> Column:
    pairs = [F.lit(x) for kv in CONFIDENCE_NOTES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), _c(c))
