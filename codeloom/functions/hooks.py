"""Where a model would stand: deterministic stand-ins with the shape of the real thing.

Each takes and returns columns, so a model-backed pandas UDF can be put in its place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def embed(tokens: Column, dim: int = 64) -> Column:
    """A unit vector of hashed tokens; null for none."""
    slots = F.transform(F.array_distinct(tokens), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(F.size(tokens) > 0, F.transform(raw, lambda x: x / norm))


def relevance_logit(query: Column, text: Column) -> Column:
    """Between -2 and 2 by the share of the query's tokens that the text has."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, 4.0 * F.size(F.array_intersect(q, text)) / F.size(q) - 2.0).otherwise(-2.0)


def passage_text(unit: Column, name: Column, code: Column) -> Column:
    """What a passage encoder is given."""
    return F.concat(F.lit("passage: "), F.coalesce(unit, F.lit("")), F.lit(" "), F.coalesce(name, F.lit("")), F.lit("\n"), F.substring(F.coalesce(code, F.lit("")), 1, 2000))


def prompt(titles_and_codes: Column, top: int = 5, cap: int = 1100) -> Column:
    """Numbered blocks of the first hits, each cut at ``cap``; the input is an array of (title, code)."""
    return F.array_join(F.transform(F.slice(titles_and_codes, 1, top), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["title"], F.lit("\n"), F.substring(x["code"], 1, cap))), "\n\n")
