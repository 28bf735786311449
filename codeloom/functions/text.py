"""Text and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values of the ranking formulas
RRF_K = 60
WEIGHTS = {"dense": 1.0, "sparse": 0.6}


def identifier_tokens(c: Column) -> Column:
    """Distinct lower-case tokens of an identifier: cut at case changes, digits stay with what precedes them, _ and punctuation separate.

    Null gives an empty array.
    """
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    t = F.regexp_replace(t, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def name_boost(query: Column, name: Column) -> Column:
    """1 + 2 * coverage * (0.5 + 0.5 * precision) of two token arrays; 1 if either is empty or nothing is shared."""
    both = F.size(F.array_intersect(query, name)).cast("double")
    return F.when(both > 0, 1 + 2 * (both / F.size(query)) * (0.5 + 0.5 * both / F.size(name))).otherwise(F.lit(1.0))


def priority_boost(stars: Column) -> Column:
    return 1 + 0.08 * F.coalesce(stars, F.lit(0)).cast("double")


def score_multiplier(combined: Column) -> Column:
    """Between 0.88 and 1.12 for a score clamped to 1..10, neutral at 5.5 and without score."""
    c = F.greatest(F.lit(1.0), F.least(F.lit(10.0), combined.cast("double")))
    return F.when(combined.isNull(), F.lit(1.0)).otherwise(1 + 0.12 * (c - 5.5) / 4.5)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def context_window(chars: Column, n_predict: Column) -> Column:
    """Tokens of context for a prompt: chars / 3.5 + n_predict + 256, between 4096 and 16384."""
    return F.greatest(F.lit(4096), F.least(F.lit(16384), F.floor(chars / 3.5) + n_predict + 256)).cast("int")


def bare_name(c: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(c, "[.]"), -1)))


def before_equals(c: Column) -> Column:
    return F.trim(F.split_part(c, F.lit("="), F.lit(1)))


def slug(c: Column, default: str = "section") -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one dash, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", default).otherwise(s)


def chapter_key(path: Column, default: str = "general") -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit(default))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def safe_path(client: Column, path: Column) -> Column:
    """Whether a client may write this relative path: plain client id, no drive, not absolute, nothing above its root."""
    p = F.translate(path, "\\", "/")
    parts = F.split(p, "/")
    ok = client.rlike(r"^[A-Za-z0-9_.\-]{1,64}$") & ~client.isin(".", "..") & (p != "") & ~p.contains(":") & ~p.startswith("/")
    return F.coalesce(ok & ~F.exists(parts, lambda x: x == ".."), F.lit(False))


def json_array(c: Column) -> Column:
    """The outermost [...] of a noisy text, or null."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\[.*\])", 1), F.lit(""))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def url_origin(c: Column) -> Column:
    """scheme://host of an http(s) address that is no link-local one, else null."""
    u = F.regexp_extract(F.trim(c), r"^(?i)(https?://[^/?#\s]+)", 1)
    return F.when((u != "") & ~u.rlike(r"^(?i)https?://(?:[^@/]*@)?(?:169\.254\.|\[?fe80:)"), F.regexp_replace(F.lower(u), r"//[^@/]*@", "//"))


def js_escape(c: Column) -> Column:
    """For a string in single quotes inside an attribute: backslashes and quotes as JavaScript, then HTML."""
    return html_escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")))


def without_unit(title: Column, unit: Column) -> Column:
    """A title without " (unit)" at its end, if that is its unit."""
    tail = F.concat(F.lit(" ("), unit, F.lit(")"))
    return F.when(F.coalesce(title.endswith(tail), F.lit(False)), F.substring(title, F.lit(1), F.char_length(title) - F.char_length(tail))).otherwise(title)


def strict_base64(c: Column) -> Column:
    """The bytes of a base64 text, null where it isn't one: wrong characters, length or padding."""
    return F.when(c.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.unbase64(c))


def link_names(text: Column, names: Column, own: Column) -> Column:
    """Markdown text with known names (an array) as links, outside `code`, but not the own one; longer names first."""
    usable = F.filter(names, lambda n: (n != own) & (n != ""))
    longest = F.array_sort(usable, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = F.transform(longest, lambda n: F.regexp_replace(n, r"([\\\[\](){}.*+?^$|])", r"\\$1"))
    pattern = F.concat(F.lit(r"\b("), F.array_join(quoted, "|"), F.lit(r")\b"))
    # every second part stands in backticks
    parts = F.transform(F.split(text, "`"), lambda x, i: F.when(i % 2 == 1, x).otherwise(F.regexp_replace(x, pattern, F.lit("[$1](#$1)"))))
    return F.when(F.size(usable) > 0, F.array_join(parts, "`")).otherwise(text)


def block_html(kind: Column, content: Column) -> Column:
    """A Markdown block as HTML."""
    c = html_escape(content)
    wrap = lambda tag: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    return F.when(kind.isin("h1", "h2", "h3"), F.concat(F.lit("<"), kind, F.lit(">"), c, F.lit("</"), kind, F.lit(">"))).when(kind == "li", wrap("li")).when(kind == "code", wrap("pre")).otherwise(wrap("p"))
