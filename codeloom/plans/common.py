"""What the catalogue modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.model import current, table

CUR = "cur AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) = 1)"
COLUMNS = ["collection", "unit", "kind", "name", "line_start", "code", "doc", "lang", "uses_list", "extends_list"]


def cur(spark, d, cols=None) -> DataFrame:
    return current(table(spark, d, "chunks"), list(cols or COLUMNS))


def wide(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, as the SQL twins have them."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])
