"""Reading the tables: current rows, file paths, type names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current(df: DataFrame, cols: list[str], key: str = "id", version: str = "indexed_at") -> DataFrame:
    """The newest row of each key, with the named columns only.

    Rows that tie are identical, so one of them is kept. A null version is older
    than any other. Rows without a key have no identity and are left out. Hand in
    narrow columns: what is not yet extracted is shuffled.
    """
    rest = [c for c in cols if c != key]
    # the extra field keeps max_by from seeing a null ordering
    newest = F.max_by(F.struct(*rest), F.coalesce(F.col(version), F.lit("0001-01-01").cast("timestamp"))).alias("_r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def file_path(unit: Column) -> Column:
    """A unit with / as separator and without leading ./ ."""
    return F.regexp_replace(F.translate(F.trim(unit), "\\", "/"), r"^(?:\./+)+", "")


def type_name(name: Column) -> Column:
    """A type name as it is compared: no type arguments, last segment, trimmed, lower case; null if nothing is left."""
    for _ in range(4):  # arguments nest; four levels, then whatever is still open is cut
        name = F.regexp_replace(name, r"<[^<>]*>", "")
    name = F.regexp_replace(name, r"<.*$", "")
    last = F.regexp_extract(name, r"([^.]*)$", 1)
    return F.nullif(F.lower(F.regexp_replace(last, r"^\s+|\s+$", "")), F.lit(""))


def line_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\r\n|\r|\n")) + 1
