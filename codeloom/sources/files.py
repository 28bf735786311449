"""Source trees and chunk files as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: languages by suffix
LANGUAGES = {
    "pas": "pascal", "pp": "pascal", "dpr": "pascal", "inc": "pascal", "py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript",
    "java": "java", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "h": "c", "c": "c", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "kt": "kotlin", "swift": "swift", "scala": "scala",
}


def language(path: Column) -> Column:
    """The language of a path's suffix, null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)))


def glob_pattern(glob: str) -> str:
    """A regular expression for the whole relative path. * and ? stay inside a folder, ** crosses folders; a glob without / is for file names in any folder."""
    g = glob.strip().replace("\\", "/").removeprefix("./").lstrip("/")
    if "/" not in g:
        g = f"**/{g}"
    out, i = "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(g[i], re.escape(g[i])), i + 1
    return f"^{out}$"


def source_tree(spark: SparkSession, root: str, patterns: str | None = None) -> DataFrame:
    """unit, lang, modified, size, content of the files below root whose suffix is known; patterns are globs for the path below root, separated by commas."""
    globs = [g.strip() for g in (patterns or "*").split(",") if g.strip()] or ["*"]
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(re.sub(r"^file:/*", "/", root).rstrip("/") + "/")
    unit = F.regexp_replace("path", r"^file:/*", "/")
    d = d.select(F.when(F.startswith(unit, base), F.substring(unit, F.length(base) + 1, F.length(unit))).otherwise(unit).alias("unit"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    wanted = F.lit(False)
    for g in globs:
        wanted = wanted | F.col("unit").rlike(glob_pattern(g))
    return d.where(wanted).withColumn("content", F.decode("content", "UTF-8")).withColumn("lang", language(F.col("unit"))).where("lang is not null").select("unit", "modified", "size", "content", "lang")


def is_dirty(tree: DataFrame, since) -> bool:
    """Whether a file changed after ``since``; deletions are not seen."""
    return not tree.where(F.col("modified") > F.lit(since)).isEmpty()


def chunk_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines chunks keyed by id; of repeated ids the last line of the last file, by name, wins. Rows without id are left out."""
    d = spark.read.schema(schema).json(path)
    # ids of one file grow along it; between files the name decides
    d = d.select(F.struct("*").alias("r"), F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    return d.where("r.id is not null").groupBy("r.id").agg(F.max_by("r", "at").alias("r")).select("r.*")


def line_slice(content: Column, first: Column, last: Column) -> Column:
    """Lines first to last of a text, from 1, both included."""
    return F.array_join(F.slice(F.split(F.regexp_replace(content, r"\r\n?", "\n"), "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")
