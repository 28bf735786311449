"""Source files to chunks, as column expressions: no parser, top-level heads found by line patterns.

What a syntax tree would tell is approximated: a function or type runs from its head at the start of a line to the next
head, comment and attribute lines directly above belong to it, and members of types stay inside their type.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHARS = 40
HUGE_LINES = 400
NAME_CAP = 80

# fixed patterns: heads at the start of a line, with the name as the group
_METHOD = {
    "pascal": r"(?i:(?:class )?(?:procedure|function|constructor|destructor) +)([\w.<>]+)",
    "python": r"(?:async )?def +(\w+)",
    "go": r"func +(?:\([^)]*\) *)?(\w+)",
    "rust": r"(?:pub(?:\([^)]*\))? +)?(?:async +|unsafe +|const +)*fn +(\w+)",
    "javascript": r"(?:export +)?(?:async +)?(?:function\*? +|const +(?=\w+ *= *(?:async *)?\())(\w+)",
    "other": r"(?:(?:public|private|protected|internal|static|final|virtual|override|inline|async|extern) +)*(?!return|else|new|class|struct|interface|enum|namespace|using|import|package)[\w<>\[\],.:*&?]+[ *&]+(?:\w+::)?(\w+)(?= *\([^;]*$)",
}
_TYPE = {
    "pascal": r"(\w+(?:<[^>]*>)?) *= *(?i:class|interface|record|object)\b(?! of\b)",
    "python": r"class +(\w+)",
    "go": r"type +(\w+) +(?:struct|interface)",
    "rust": r"(?:pub(?:\([^)]*\))? +)?(?:struct|enum|trait|impl(?:<[^>]*>)?(?: +\w+ +for)?) +(\w+)",
    "javascript": r"(?:export +(?:default +)?)?class +(\w+)",
    "other": r"(?:(?:public|private|protected|internal|static|final|sealed|abstract|partial) +)*(?:class|interface|struct|enum|record) +(\w+)",
}
_ABOVE = r"(?:(?:[ \t]*(?://|#|/?\*|\(\*|\{|@|\[).*)\n)*"
#: how a type's head names what it derives from: the tokens that open the list (for ( the token before it), and those that close it
_OPENS = {"pascal": ["class", "interface", "object", "abstract", "sealed"], "python": None, "java": ["extends", "implements"], "javascript": ["extends", "implements"], "typescript": ["extends", "implements"], "csharp": [":"], "cpp": [":"], "rust": ["impl"]}
_CLOSES = {"pascal": [")"], "python": [")"], "csharp": ["where"], "rust": ["for"]}


def _by_language(table: dict[str, str], build) -> Column:
    out = build(table["other"])
    for lang, pattern in table.items():
        if lang != "other":
            out = F.when(F.col("lang") == lang, build(pattern)).otherwise(out)
    return out


def _flat(pattern: str) -> str:
    """The pattern without capturing groups."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def _type_of(method_pattern: str) -> str:
    return next(_TYPE[k] for k, p in _METHOD.items() if p == method_pattern)


def stable_id(*parts: Column) -> Column:
    """A 48-bit number of the parts' text; line numbers are no part, so moved code keeps its id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("bigint")


def head_tokens(code: Column, lang: Column) -> Column:
    """The tokens of a type's head, without comments above it, type arguments and body; :: is one token with its names."""
    body = F.when(lang == "python", ":").when(lang == "pascal", ";").otherwise("{")
    head = F.split_part(F.regexp_replace(code, "^" + _ABOVE, ""), body, F.lit(1))
    for _ in range(4):
        head = F.regexp_replace(head, r"<[^<>]*>", "")
    head = F.replace(head, F.lit("::"), F.lit("\x01"))
    return F.filter(F.split(F.regexp_replace(head, r"([,:()=])", " $1 "), r"\s+"), lambda t: t != "")


def parents(code: Column, lang: Column) -> Column:
    """Names that a type's head derives from, without type arguments, modifiers and qualifiers.

    The list begins behind the first token that opens it, ends at one that closes it, and is cut at its commas; of each part the last word is the name.
    """
    tokens = head_tokens(code, lang)
    at = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)))
    token = lambda i: F.coalesce(F.lower(F.get(tokens, i - 1)), F.lit(""))
    out = F.array().cast("array<string>")
    for name, opens in _OPENS.items():
        bracket = name in ("pascal", "python")
        opened = (lambda i: (token(i) == "(") & ((token(i - 1)).isin(opens) if opens else F.lit(True))) if bracket else (lambda i: token(i).isin(opens))  # noqa: B023, E731
        first = F.array_min(F.filter(at, opened))
        rest = F.slice(tokens, first + 1, F.greatest(F.size(tokens) - first, F.lit(0)))
        for close in _CLOSES.get(name, []):
            end = F.array_position(rest, close).cast("int")
            rest = F.when(end > 0, F.slice(rest, 1, end - 1)).otherwise(F.lit(None) if name == "rust" else rest)
        listed = F.transform(rest, lambda t: F.when(t.isin("extends", "implements"), ",").otherwise(t))
        out = F.when(lang == name, F.coalesce(listed, F.array().cast("array<string>"))).otherwise(out)
    named = F.transform(F.filter(F.split(F.array_join(out, " "), ","), lambda x: ~x.contains("=")), lambda x: F.element_at(F.split(F.concat(F.lit(" "), F.trim(x)), r"[\s.\x01]+"), -1))
    return F.filter(named, lambda x: x.rlike(r"^\w+$"))


def imports(code: Column, lang: Column) -> Column:
    """What a file or unit head imports, distinct and in order; python and rust by the first segment. A head that lists "<lang> imports:" is read as that list.

    Read line by line: the word a line begins with says whether it imports. Pascal takes all its uses clauses, without comments and file parts. No cap.
    """
    text = F.regexp_replace(F.coalesce(code, F.lit("")), r"\r\n?", "\n")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    words = lambda x: F.filter(F.split(x, r"[\s;,]+"), lambda w: ~w.isin("", "static", "global"))
    second = lambda x: F.get(words(x), F.lit(1))
    begins = lambda x, *w: F.get(words(x), F.lit(0)).isin(*w)
    quoted = lambda x: F.regexp_extract(x, "[\"'<]([^\"'<>]+)[\"'>]", 1)
    pick = lambda test, name: F.transform(F.filter(lines, test), name)
    script = pick(lambda x: begins(x, "import") | x.contains("require(") | x.rlike(r"^\}.*\bfrom\b"), quoted)
    by = {
        "python": pick(lambda x: begins(x, "import", "from"), lambda x: F.substring_index(second(x), ".", 1)), "rust": pick(lambda x: begins(x, "use"), lambda x: F.substring_index(second(x), "::", 1)),
        "java": pick(lambda x: begins(x, "import") & x.endswith(";"), second), "csharp": pick(lambda x: begins(x, "using") & x.endswith(";") & ~x.rlike("[=(]"), second),
        "c": pick(lambda x: x.rlike(r"^#\s*include"), quoted), "cpp": pick(lambda x: x.rlike(r"^#\s*include"), quoted), "javascript": script, "typescript": script, "tsx": script,
        # a line of a block holds a name at most besides the path
        "go": pick(lambda x: begins(x, "import") | x.rlike(r'^(?:[\w.]+\s+)?"[^"]+"$'), quoted),
    }
    bare = F.regexp_replace(text, r"//[^\n]*|\{[^}]*\}|\(\*[^*]*\*\)", " ")
    clauses = F.flatten(F.transform(F.regexp_extract_all(bare, F.lit(r"(?is)\buses\b([^;]*)"), F.lit(1)), lambda c: F.split(c, ",")))
    out = F.transform(clauses, lambda x: F.regexp_extract(x, r"([A-Za-z_][\w.]*)", 1))
    for name, found in by.items():
        out = F.when(lang == name, found).otherwise(out)
    listed = F.concat(F.coalesce(lang, F.lit("pascal")), F.lit(" imports:"))
    at = F.array_position(lines, listed).cast("int")
    out = F.when(at > 0, F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0)))).otherwise(out)
    return F.array_distinct(F.filter(out, lambda x: x.isNotNull() & (x != "")))


def documentation(above: Column, code: Column, lang: Column, cap: int = 600) -> Column:
    """The comment lines above a piece, without marks and tags, or a Python docstring; at most ``cap`` characters, '' for none."""
    lines = F.filter(F.split(above, "\n"), lambda x: x.rlike(r"^[ \t]*(?://|#(?!\[)|/?\*|\(\*|\{)"))
    text = F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[ \t]*(?://[/!]*|#+|/?\*+/?|\(\*|\{)|(?:\*/|\*\)|\})[ \t]*$", ""))), " ")
    string = F.regexp_extract(code, '(?s)^[^\\n]*:\\s*(?:"""(.*?)"""|\'\'\'(.*?)\'\'\')', 1)
    doc = F.when((lang == "python") & (string != ""), string).otherwise(text)
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(doc, r"</?\w+[^<>]*>", ""), r"\s+", " ")), 1, cap)


def chunk_files(files: DataFrame, lib: str) -> DataFrame:
    """lib, unit, lang, kind, name, line_start, line_end, code, doc, id, hash, extends_list, uses_list, huge, parent_id, part_index, parts_total from files (unit, lang, content).

    Chunks under 40 characters are noise. Code of more than 400 lines keeps its first 400 and is marked huge; all of it
    follows in method_part chunks of 400 lines, whose parent_id is its id. A unit head has the file's imports, and its hash is that of their sorted list. Null content has no chunks.
    """
    text = F.regexp_replace("content", r"\r\n?", "\n")
    f = files.where("content is not null and unit is not null").select("unit", F.coalesce("lang", F.lit("pascal")).alias("lang"), text.alias("content"))
    # a head starts a piece, together with the comments and attributes right above it
    marked = _by_language(_METHOD, lambda p: F.regexp_replace("content", f"(?m)^({_ABOVE}(?:{_flat(p)}|{_flat(_type_of(p))}))", "\x02$1"))
    f = f.withColumn("pieces", F.split(marked, "\x02"))
    # lines before each piece, as numbers, so that no text is carried along twice
    f = f.withColumn("breaks", F.transform("pieces", lambda x: F.regexp_count(x, F.lit("\n"))))
    starts = F.transform(F.sequence(F.lit(0), F.size("pieces") - 1), lambda i: F.aggregate(F.slice("breaks", F.lit(1), i), F.lit(1), lambda x, y: x + y))
    p = f.select("unit", "lang", F.when(F.lit(True), imports(F.col("content"), F.col("lang"))).alias("uses"), F.posexplode(F.arrays_zip(F.col("pieces").alias("code"), starts.alias("line_start"))).alias("pos", "p"))
    p = p.select("unit", "lang", "pos", F.when(F.col("pos") == 0, F.col("uses")).alias("uses"), F.regexp_replace("p.code", r"\s+$", "").alias("code"), F.col("p.line_start").alias("line_start"))
    head = F.regexp_replace("code", r"^" + _ABOVE, "")
    m, t = (_by_language(table, lambda p: F.regexp_extract(head, f"(?m)^(?:{p})", 1)) for table in (_METHOD, _TYPE))
    kind = F.when(F.col("pos") == 0, "unithead").when(t != "", "type").otherwise("method")
    name = F.when(F.col("pos") == 0, F.regexp_extract("unit", r"([^/]*?)(?:\.[^./]*)?$", 1)).when(t != "", t).otherwise(m)
    above = F.regexp_extract("code", "^(" + _ABOVE + ")", 1)
    doc = F.when(F.col("pos") == 0, "").otherwise(documentation(above, head, F.col("lang")))
    p = p.select("unit", "lang", kind.alias("kind"), F.substring(name, 1, NAME_CAP).alias("name"), "line_start", "code", doc.alias("doc"), "uses", F.split("code", "\n").alias("lines"))
    p = p.where((F.length("code") >= MIN_CHARS) | (F.col("kind") == "unithead"))
    n = F.size("lines")
    ident = lambda part, code: stable_id(F.lit(lib), F.col("unit"), F.concat_ws("/", "kind", part), F.substring(code, 1, 160))
    whole = p.withColumn("huge", n > HUGE_LINES).withColumn("line_end", (F.col("line_start") + n - 1).cast("int")).withColumn("id", ident(F.lit(""), F.col("code")))
    none = F.lit(None)
    cut = F.when(F.col("huge"), F.array_join(F.slice("lines", 1, HUGE_LINES), "\n")).otherwise(F.col("code"))
    digest = F.when((F.col("kind") == "unithead") & (F.size("uses") > 0), F.md5(F.array_join(F.array_sort("uses"), "\n"))).otherwise(F.md5("code"))
    extends = F.when(F.col("kind") == "type", parents(F.col("code"), F.col("lang")))
    top = whole.select("unit", "lang", "kind", "name", "line_start", "line_end", cut.alias("code"), "doc", "id", digest.alias("h"), extends.alias("extends_list"), F.col("uses").alias("uses_list"), "huge", none.cast("bigint").alias("parent_id"), none.cast("int").alias("part_index"), none.cast("int").alias("parts_total"))
    parts = whole.where("huge").withColumn("parts_total", F.ceil(n / HUGE_LINES).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts_total") - 1)))
    body = F.array_join(F.slice("lines", F.col("i") * HUGE_LINES + 1, HUGE_LINES), "\n")
    start = (F.col("line_start") + F.col("i") * HUGE_LINES).cast("int")
    parts = parts.select(
        "unit", "lang", F.lit("method_part").alias("kind"), F.format_string("%s [%d/%d]", "name", F.col("i") + 1, "parts_total").alias("name"), start.alias("line_start"), F.least(start + HUGE_LINES - 1, "line_end").alias("line_end"), body.alias("code"), F.lit("").alias("doc"),
        F.col("id").alias("parent_id"), F.md5(body).alias("h"), (F.col("i") + 1).cast("int").alias("part_index"), "parts_total",
    ).withColumn("id", ident(F.col("part_index").cast("string"), F.col("code")))
    c = top.unionByName(parts.withColumn("huge", F.lit(False)), allowMissingColumns=True)
    return c.select(F.lit(lib).alias("lib"), "unit", "lang", "kind", "name", "line_start", "line_end", "code", "doc", "id", F.substring("h", 1, 12).alias("hash"), "extends_list", "uses_list", "huge", "parent_id", "part_index", "parts_total")
