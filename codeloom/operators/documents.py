"""Texts put together from parts: whole units, context packs, markdown blocks, overlays, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_unit(chunks: DataFrame, cap: int | None = 150_000) -> DataFrame:
    """collection, unit, n_chunks, n_used, truncated, content: a unit's chunks by line, up to the first that overflows the cap (None: all).

    The running length is a window over one unit; only chunks under the cap are collected, so no row exceeds it.
    """
    c = chunks.where("unit is not null").select("collection", "unit", "id", F.coalesce("line_start", F.lit(0)).alias("line"), F.concat(F.lit("# "), F.coalesce("name", F.lit("")), F.lit("\n"), F.coalesce("code", F.lit(""))).alias("part"))
    kept = F.struct("line", "id", "part")
    if cap is not None:
        w = Window.partitionBy("collection", "unit").orderBy("line", "id")
        c = c.withColumn("used", F.sum(F.char_length("part") + 1).over(w))
        kept = F.when(F.col("used") <= cap, kept)
    g = c.groupBy("collection", "unit").agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_list(kept)).alias("parts"))
    return g.select("collection", "unit", "n_chunks", F.size("parts").alias("n_used"), (F.size("parts") < F.col("n_chunks")).alias("truncated"), F.array_join("parts.part", "\n").alias("content"))


def pack(sections: DataFrame, budget: int, by: list[str]) -> DataFrame:
    """by..., used_chars, used_tokens, kept, omitted: sections (ord, title, n_chars) taken in order if they fit what is left; one too long is skipped and the next tried.

    Sections of a group are bounded by the search page that they come from.
    """
    g = sections.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", "title", F.col("n_chars").cast("int").alias("n_chars")))).alias("s"))
    fold = F.aggregate(
        "s", F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("omitted")),
        lambda a, x: F.when(a["used"] + x["n_chars"] <= budget, F.struct((a["used"] + x["n_chars"]).alias("used"), F.concat(a["kept"], F.array(x["title"])).alias("kept"), a["omitted"].alias("omitted")))
        .otherwise(F.struct(a["used"].alias("used"), a["kept"].alias("kept"), F.concat(a["omitted"], F.array(x["title"])).alias("omitted"))),
    )
    return g.withColumn("f", fold).select(*by, F.col("f.used").alias("used_chars"), F.floor(F.col("f.used") / 4).cast("int").alias("used_tokens"), F.col("f.kept").alias("kept"), F.col("f.omitted").alias("omitted"))


def markdown_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, part, pos, kind, content of the non-blank lines: h1-h3, li, code (between fences), p. Fences are no blocks.

    Fences cut a text into parts, of which every second is code; pos counts lines within the part. No shuffle.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n")
    d = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(clean, r"(?m)^[ \t]*```[^\n]*$")).alias("part", "body"))
    d = d.select("doc_id", "part", F.posexplode(F.split("body", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    code = F.pmod(F.col("part"), F.lit(2)) == 1
    kind = F.when(code, "code").when(F.col("line").rlike("^### "), "h3").when(F.col("line").rlike("^## "), "h2").when(F.col("line").rlike("^# "), "h1").when(F.col("line").rlike(r"^[ \t]*[-*] "), "li").otherwise("p")
    content = F.when(code, F.col("line")).otherwise(F.trim(F.regexp_replace("line", r"^(#{1,3} |[ \t]*[-*] )", "")))
    return d.select("doc_id", "part", "pos", kind.alias("kind"), content.alias("content"))


def overlay(base: DataFrame, translations: DataFrame, key: list[str], body: str, lang: str) -> DataFrame:
    """base with its body in a language where there is a translation, and whether there is."""
    t = translations.where(F.col("lang") == lang).groupBy(*key).agg(F.min("body").alias("_t"))
    return base.join(t, key, "left").withColumn("translated", F.col("_t").isNotNull()).withColumn(body, F.coalesce("_t", body)).drop("_t")


def chat_history(turns: DataFrame, by: str, order: list[Column], text: str, n: int = 4, cap: int = 400) -> DataFrame:
    """The last n turns of each group, oldest first, each cut at ``cap``."""
    w = Window.partitionBy(by).orderBy(*order)
    t = turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
    return t.select(by, (n - F.col("back") + 1).alias("turn"), F.substring(text, 1, cap).alias("turn_text"))
