"""Functions paired with their documentation.

Comment spans and function spans are found independently of each other and make up a table each, as offsets into a chunk's code. A comment
reaches up to the end of the first statement after it. An as-of interval join by chunk and offset gives each
function the nearest comment before it, if the function begins within that comment's reach; a statement or another
function in between ends the reach.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_WORDS = 4

#: rows of both tables: of a comment pos is the end, other the start, reach how far it may document; of a function pos is the start, other the end
_SPANS = "id bigint, v bigint, is_function boolean, pos int, other int, reach int, fn_name string, text string, doc string, code string"

# comments and strings, per family of languages
_SLASH = r"//[^\r\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE = r'"(?:\\.|[^"\\\r\n])*"'
_SINGLE = r"'(?:\\.|[^'\\\r\n])*'"
_TOKENS = {
    "pascal": r"//[^\r\n]*|\{.*?(?:\}|\Z)|\(\*.*?(?:\*\)|\Z)|'[^'\r\n]*'",
    "python": r"#[^\r\n]*|(?:\b[rbuRBUfF]{1,2})?(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|" + _DOUBLE + "|" + _SINGLE + ")",
    "rust": _SLASH + r'|r#+".*?"#+|' + _DOUBLE + r"|'(?:\\[^'\r\n]+|[^'\\\r\n])'",
    "csharp": _SLASH + r'|@"(?:[^"]|"")*"|' + _DOUBLE + "|" + _SINGLE,
    "javascript": _SLASH + "|" + _DOUBLE + "|" + _SINGLE + r"|`(?:\\.|[^`\\])*`",
    "go": _SLASH + "|" + _DOUBLE + "|" + _SINGLE + "|`[^`]*`",
}
_TOKENS["java"] = _TOKENS["cpp"] = _TOKENS["other"] = _SLASH + '|"""' + r'.*?"""|' + _DOUBLE + "|" + _SINGLE
_TOKENS = {k: re.compile(v, re.S) for k, v in _TOKENS.items()}
_COMMENT = {"pascal": ("//", "{", "(*"), "python": ("#",)}
_LINE_COMMENT = {"python": "#"}

# function heads on code whose comments and strings are blanked; the name is the last group that matched
_PAREN = r"\s*\([^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*\)"
_TYPED = re.compile(rf"^[ \t]*+(?:template\s*<[^{{}};]*>\s*)?(?:[\w<>\[\],.:?~]+[ \t*&]+)*?(?:\w+(?:<[^<>()]*>)?(?:::|\.))*([~\w]+|operator[^\w\s(]+)(?:<[^<>()]*>)?{_PAREN}([^;{{}}()=]*(?:\([^()]*\)[^;{{}}()=]*)*)(\{{|=>)", re.M)
_HEADS = {
    "go": re.compile(rf"^[ \t]*+func[ \t]+(?:\([^()]*\)[ \t]*)?(\w+)(?:\[[^\]]*\])?{_PAREN}[^{{}};\r\n]*\{{", re.M),
    "rust": re.compile(rf"^[ \t]*+(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|default|extern)\s+)*fn\s+(\w+)(?:<[^(){{}}]*>)?{_PAREN}[^{{}};]*\{{", re.M),
    "javascript": re.compile(
        r"^[ \t]*+(?:(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)" + _PAREN + r"\s*\{"
        r"|(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:function\b\s*\*?\s*\w*" + _PAREN + r"\s*\{|" + _PAREN.removeprefix(r"\s*") + r"\s*=>|\w+\s*=>)"
        r"|(?:static\s+)?(#?\w+)\s*=\s*(?:async\s*)?(?:" + _PAREN.removeprefix(r"\s*") + r"|\w+)\s*=>"
        r"|(?:(?:static|async|get|set)\s+)*+\*?[ \t]*+(#?\w+)" + _PAREN + r"\s*\{)", re.M),
    "java": _TYPED, "csharp": _TYPED, "cpp": _TYPED, "other": _TYPED,
}
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "new", "using", "lock", "sizeof", "foreach", "synchronized", "with", "try", "fixed", "throw", "await", "function", "when"}
_LONE_CR = re.compile(r"\r(?!\n)")
_BRACE = re.compile(r"[{}]")
_PY_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*(?:\[[^\]]*\])?" + _PAREN + r"[^:\r\n]*:", re.M)
_PY_DOC = re.compile(r"\s*((?:[rRuU])?(\"\"\"|'''|\"|'))")
_PAS = re.compile(r"\b(procedure|function|constructor|destructor|operator|begin|case|try|asm|record|end|forward|external)\b", re.I)
_PAS_NAME = re.compile(r"\s+([\w<>,]+(?:[ \t]*\.[ \t]*[\w<>,]+)*)")
_LINE = re.compile(r"[^\r\n]+")
# what may stand between a comment and its function: attributes, decorators, modifiers on lines of their own
_ANNOTATION = re.compile(r"\s*(?:@[\w.]+(?:\s*\(.*\))?\s*|#!?\[.*\]\s*|\[.*\]\s*)+\Z")


def language(lang: str | None) -> str:
    """The family of a chunk's language; null means Pascal."""
    lang = (lang or "pascal").strip().lower() or "pascal"
    lang = {"c++": "cpp", "c": "cpp", "c#": "csharp", "cs": "csharp", "js": "javascript", "typescript": "javascript", "ts": "javascript", "py": "python", "rs": "rust", "golang": "go", "delphi": "pascal"}.get(lang, lang)
    return lang if lang in _TOKENS else "other"


def _blank(text: str) -> str:
    return re.sub(r"[^\r\n]", " ", text)


def _mask(code: str, lang: str) -> tuple[str, list[tuple[int, int]]]:
    """Code with blanks for comments and strings, and the comment spans; line comments below each other are one span."""
    out, spans, at, opens = [], [], 0, _COMMENT.get(lang, ("//", "/*"))
    line = _LINE_COMMENT.get(lang, "//")
    for m in _TOKENS[lang].finditer(code):
        s, e = m.span()
        t = m.group()
        comment = t.startswith(opens)
        # strings stay visible as something: a line with one is a statement
        out += (code[at:s], _blank(t) if "\n" in t or "\r" in t else (" " if comment else '"') * (e - s))
        if comment:
            gap = code[spans[-1][1] : s] if spans else "x"
            if t.startswith(line) and not gap.strip() and len(re.findall(r"\r\n|\r|\n", gap)) == 1 and code.startswith(line, spans[-1][0]) and _alone(code, spans[-1][0]):
                spans[-1] = (spans[-1][0], e)
            else:
                spans.append((s, e))
        at = e
    out.append(code[at:])
    return "".join(out), spans


def _alone(code: str, at: int) -> bool:
    """Only blanks before this place in its line."""
    a = max(code.rfind("\n", 0, at), code.rfind("\r", 0, at)) + 1
    return not code[a:at].strip()


def _close(masked: str, at: int) -> int:
    """The end of the block that opens at ``at``."""
    depth = 0
    for m in _BRACE.finditer(masked, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(masked)


def _braced(masked: str, code: str, lang: str) -> list[tuple[int, int, str, int, int]]:
    out, at = [], 0
    while m := _HEADS[lang].search(masked, at):
        name = next(g for g in m.groups() if g)
        words = masked[m.start() : m.end()].split()
        if name in _NOT_NAMES or (words and words[0] in ("return", "else", "throw", "await", "new", "=", "case", "goto")):
            at = m.end()
            continue
        s = m.start() + len(m.group()) - len(m.group().lstrip())
        if masked[m.end() - 1] == "{":
            e = _close(masked, m.end() - 1)
        elif (b := re.compile(r"\s*\{").match(masked, m.end())) is not None:
            e = _close(masked, b.end() - 1)
        else:  # => expression
            e = (re.compile(r"[^;\r\n]*;?").match(masked, m.end()) or m).end()
        out.append((s, e, name.lstrip("#"), -1, -1))
        at = max(e, m.end())
    return out


def _trim(code: str, comments: list[tuple[int, int]], s: int, e: int) -> int:
    """The end of a Python function without what follows its body: blank lines, and comments that aren't indented deeper than its head."""
    indent = len(code[max(code.rfind("\n", 0, s), code.rfind("\r", 0, s)) + 1 : s].expandtabs())
    while True:
        e = s + len(code[s:e].rstrip())
        a = max(code.rfind("\n", s, e), code.rfind("\r", s, e)) + 1
        at = a + len(code[a:e]) - len(code[a:e].lstrip())
        i = bisect_right(comments, (at, len(code))) - 1
        if not a or i < 0 or at >= comments[i][1] or len(code[a:at].expandtabs()) > indent:
            return e
        e = a


def _python(masked: str, code: str, lang: str) -> list[tuple[int, int, str, int, int]]:
    out, end = [], 0
    for m in _PY_DEF.finditer(masked):
        if m.start() < end:
            continue  # inside a function's body
        indent = len(m.group(1).expandtabs())
        end = len(masked)
        for line in _LINE.finditer(masked, m.end()):
            t = line.group()
            if t.strip() and len(t.expandtabs()) - len(t.expandtabs().lstrip()) <= indent and line.start() != m.end() and _alone(masked, line.start()):
                end = line.start()
                break
        ds = de = -1
        if d := _PY_DOC.match(code, m.end()):
            q = code.find(d.group(2), d.end())
            ds, de = d.end(), q if q >= 0 else len(code)
        out.append((m.start() + len(m.group(1)), end, m.group(2), ds, de))
    return out


def _pascal(masked: str, code: str, lang: str) -> list[tuple[int, int, str, int, int]]:
    out, heads, depth = [], [], 0
    for m in _PAS.finditer(masked):
        w = m.group().lower()
        if w in ("forward", "external"):
            if depth == 0 and heads:
                heads.pop()
        elif w in ("begin", "case", "try", "asm", "record"):
            depth += depth > 0 or (w in ("begin", "asm") and bool(heads))
        elif w == "end":
            if depth:
                depth -= 1
                if depth == 0 and heads:
                    s, name = heads.pop()
                    if not heads:  # a routine inside another belongs to that one's body
                        out.append((s, m.end(), name, -1, -1))
        elif depth == 0 and _alone_or_class(masked, m.start()) and (n := _PAS_NAME.match(masked, m.end())):
            bare = re.sub(r"<.*?>", "", n.group(1)).split(".")[-1].strip()
            a = max(masked.rfind("\n", 0, m.start()), masked.rfind("\r", 0, m.start())) + 1
            heads.append((a + len(masked[a : m.end()]) - len(masked[a : m.end()].lstrip()), bare))
    if heads and depth:  # cut off inside the body
        out.append((heads[0][0], len(masked), heads[0][1], -1, -1))
    return out


def _alone_or_class(masked: str, at: int) -> bool:
    a = max(masked.rfind("\n", 0, at), masked.rfind("\r", 0, at)) + 1
    return masked[a:at].strip().lower() in ("", "class")


def comment_spans(masked: str, comments: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """start, end, reach of each comment: the end of the first line behind it that holds more than blanks and annotations."""
    out = []
    for s, e in comments:
        for line in _LINE.finditer(masked, e):
            t = line.group()
            if t.strip() and not _ANNOTATION.match(t):
                out.append((s, e, line.end()))
                break
        else:
            out.append((s, e, len(masked)))
    return out


def function_spans(masked: str, code: str, comments: list[tuple[int, int]], lang: str) -> list[tuple[int, int, str, int, int]]:
    """start, end, name, start and end of the docstring (-1 for none) of each function with a body."""
    find = _python if lang == "python" else _pascal if lang == "pascal" else _braced
    fns = sorted(find(masked, code, lang))
    return [(s, _trim(code, comments, s, e), *x) for s, e, *x in fns] if lang == "python" else fns


def _scan(with_code: bool):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, v, doc, lang, code in zip(b["id"], b["v"], b["doc"], b["lang"], b["code"]):
                lang, text = language(lang), _LONE_CR.sub("\n", code)  # offsets stay
                masked, comments = _mask(text, lang)
                for s, e, reach in comment_spans(masked, comments):
                    rows.append((i, v, False, e, s, reach, None, code[s:e], None, None))
                for s, e, name, ds, de in function_spans(masked, text, comments, lang):
                    rows.append((i, v, True, s, e, None, name, code[ds:de] if ds >= 0 else None, doc, code[s:e] if with_code else None))
            out = pd.DataFrame(rows, columns=["id", "v", "is_function", "pos", "other", "reach", "fn_name", "text", "doc", "code"])
            yield out.astype({"pos": "Int32", "other": "Int32", "reach": "Int32"})

    return scan


def span_table(chunks: DataFrame, with_code: bool) -> DataFrame:
    """Comment spans and function spans of the current method and type rows; a method's doc field goes with its functions if it has two characters besides blanks."""
    rows = chunks.where(F.col("kind").isin("method", "type") & F.col("id").isNotNull() & F.col("code").isNotNull())
    given = (F.col("kind") == "method") & (F.length(F.regexp_replace(F.coalesce("doc", F.lit("")), r"\s", "")) >= 2)
    spans = rows.select("id", _version().alias("v"), F.when(given, F.col("doc")).alias("doc"), "lang", "code").mapInPandas(_scan(with_code), _SPANS)
    newest = chunks.where("id is not null").groupBy("id").agg(F.max(_version()).alias("newest"))
    return spans.join(newest, "id").where("v = newest").drop("newest")


def attached(chunks: DataFrame, with_code: bool = True) -> DataFrame:
    """id, start, fn_name, code, doc, comment, docstring: each function with a body, its own code, and the texts that may document it.

    The as-of interval join: of the comments that end before the function the last, if the function begins within its reach and
    none ends in between. Rows of a chunk that tie repeat their spans; repeats are passed over.
    """
    # one shuffle by id serves the choice of current rows and the join
    at = Window.partitionBy("id", "v").orderBy("pos", "is_function", "other")
    spans, same = span_table(chunks, with_code), F.struct("pos", "is_function", "other")
    spans = spans.withColumn("repeat", F.lag(same).over(at).eqNullSafe(same)).where("not repeat")
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    f = spans.withColumn("c", F.last(F.when(~F.col("is_function"), F.struct("other", "reach", "text")), True).over(before))
    f = f.withColumn("end", F.last(F.when(F.col("is_function"), F.col("other")), True).over(before)).where("is_function")
    free = F.col("end").isNull() | (F.col("end") <= F.col("c.other"))
    near = F.when((F.col("pos") < F.col("c.reach")) & free, F.col("c.text"))
    return f.select("id", F.col("pos").alias("start"), "fn_name", "code", "doc", near.alias("comment"), F.col("text").alias("docstring"))


# --- which documentation is real; fixed patterns of tools, licences and generators -------------------------------------------

_DIRECTIVE = r"(?i)^\W*(?:(?:pylint|eslint(?:-[\w-]+)?|noqa|nolint\w*|noinspection|type|mypy|flake8|isort|fmt|yapf|pragma|istanbul|c8|jshint|jslint|tslint|prettier-ignore|ts-(?:ignore|nocheck|expect-error)|clang-(?:format|tidy)|cppcheck-suppress|coverity|sonar\w*|resharper|rustfmt|clippy|go:\w+|\+build|region|endregion|suppresswarnings|swagger:\w+|stylelint\S*|biome-ignore)\b|\$[A-Z]\w*)"
_LICENCE = r"(?i)(?:spdx-license-identifier|\bcopyright\b|\(c\)\s*\d{4}|all rights reserved|\blicen[cs]ed? under\b|permission (?:is hereby granted|to use)|redistribution and use|alle rechte vorbehalten|tüm hakları saklıdır|urheberrecht|telif hakkı)"
_GENERATOR = r"(?i)(?:\bdo not (?:edit|modify)\b|<auto-?generated|@generated\b|auto-?generated|^\W*(?:this (?:file|unit|code|class|method|function) (?:was|is|has been) (?:automatically )?(?:generated|written by|created by)|(?:code |file |automatically )?generated (?:by|from|with|code)\b|machine output)|will be overwritten|lost on the next build|automatisch (?:erzeugt|generiert)|nicht bearbeiten|otomatik (?:olarak )?(?:üretil|oluşturul)|elle değiştirmeyiniz)"
_POINTER = r"(?i)^\W*(?:(?:see|siehe|bkz\.?|refer to|as (?:in|described|documented)|same as|like|wie|documented (?:in|at|under)|inherited from|documentation (?:is )?(?:in|at|see)|for (?:details|documentation|more|a description),? see|details (?:in|see)|ayrıntılar için|beschreibung siehe|the docs? (?:of|for|are|is)|dokümantasyon)\b|\{?@?(?:inheritdoc|link|see|copydoc)\b)"


def _clean(doc: Column) -> Column:
    """A comment without its marks, XML tags and lines that start with @."""
    d = F.regexp_replace(doc, r"\r\n?", "\n")
    d = F.regexp_replace(d, r"(?m)^[ \t]*(?://[/!]*|/\*+!?|\(\*+|\*+/|\*+\)|\*+(?!\w)|#+|\{(?!@)|\})[ \t]*", "")
    d = F.regexp_replace(d, r"(?m)[ \t]*(?:\*+/|\*+\)|(?<!\w)\})[ \t]*$", "")
    d = F.regexp_replace(d, r"(?m)^[ \t]*[@\\]\w+.*$", "")
    d = F.regexp_replace(d, r"</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>", " ")
    return F.trim(F.regexp_replace(d, r"(?m)^[ \t]+|[ \t]+$", ""))


def _code_like(doc: Column) -> Column:
    """Whether every line reads as a statement."""
    lines = F.filter(F.split(doc, "\n"), lambda x: F.length(F.trim(x)) > 0)
    statement = r"^\s*(?:[})\]]+[;,]?|.*[;{}]\s*|.*\b(?:then|do|begin|else)\s*|(?:if|for|while|elif|else|return|def|fn|func|var|let|const|end)\b.*[:;){]\s*|[\w.\[\]]+\s*(?::=|[-+*/|&^]?=)\s*\S.*|return\b.*|[\w.]+\([^()]*\)\s*)$"
    sign = r":=|[\w\])]\s*(?:[-+*/|&^]?=|==|<<|\+\+)\s*|\w\s*\([^()]*\)\s*[;{]|\breturn\b[^.]*;|[{};]\s*$|\breturn\s+\w+\s*[-+*/]\s*\w+|^\s*(?:for|while|if)\b.*[:{]\s*$"
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(statement)) & F.exists(lines, lambda x: x.rlike(sign))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+(?:['’][\p{L}]+)?"), F.lit(0))


def real_text(doc: Column, name: Column) -> Column:
    """The description if it is real documentation of the function, else null."""
    d = _clean(doc)
    split = F.regexp_replace(F.regexp_replace(name, r"([\p{Ll}\d])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    own = F.transform(F.concat(_words(split), F.array(name)), lambda w: F.lower(w))
    count = F.size(F.filter(F.transform(_words(d), lambda w: F.lower(w)), lambda w: ~F.array_contains(own, w)))
    first = F.regexp_replace(d, r"(?is)^\W*(?:todo|fixme|xxx)\b[^.\n]*[.:]?", "")
    rest = F.size(F.filter(F.transform(_words(first), lambda w: F.lower(w)), lambda w: ~F.array_contains(own, w)))
    short_pointer = d.rlike(_POINTER) & (F.size(F.split(d, r"[.;!?](?:\s|$)")) <= 2) & (count <= 12)
    lines = F.filter(F.split(d, "\n"), lambda x: F.length(F.trim(x)) > 0)
    notice = lambda pattern: F.exists(lines, lambda x: x.rlike(pattern))
    bad = F.forall(lines, lambda x: x.rlike(_DIRECTIVE)) | notice(_LICENCE) | notice(_GENERATOR) | short_pointer | _code_like(d)
    return F.when((count >= MIN_WORDS) & (rest >= MIN_WORDS) & ~bad, d)


def _documented(chunks: DataFrame, with_code: bool = True) -> DataFrame:
    """id, start, fn_name, code, code_doc: the really documented functions of the current method and type rows."""
    f = attached(chunks, with_code)
    texts = F.when(F.col("doc").isNotNull(), F.array("doc")).otherwise(F.array("comment", "docstring"))
    f = f.select("id", "start", "fn_name", "code", F.transform(texts, lambda t: real_text(t, F.col("fn_name"))).alias("texts"))
    return f.select("id", "start", "fn_name", "code", F.expr("array_join(filter(texts, t -> t is not null), '\n')").alias("code_doc")).where("code_doc <> ''")


def pairs(chunks: DataFrame) -> DataFrame:
    """id, start, fn_name, code, code_doc: one row per really documented function of the current method and type rows.

    start is the function's offset in the chunk's code, so overloads stay apart. For a method its doc field counts if it has
    two characters besides blanks; otherwise, and for members of types, the comment directly above or the docstring.
    Null code has no functions; rows without id are left out; rows that tie count once.
    """
    return _documented(chunks).select("id", F.col("start").cast("bigint").alias("start"), "fn_name", "code", "code_doc")


def _version() -> Column:
    """indexed_at as a number, older than any other where it is null."""
    return F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(-(2**63)))


def found(chunks: DataFrame) -> DataFrame:
    return _documented(chunks, with_code=False).select("id", "fn_name").distinct()
