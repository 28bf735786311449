"""Aggregation by a few heavy keys: two stages, with a salt on the heavy ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.model import current
from codeloom.session import Scratch

#: A key is salted if it may hold more than this share of the rows. freqItems returns every such
#: key and at most about 1/share others, so the list has a bound that doesn't depend on the data.
HEAVY_SHARE = 0.005
SALTS = 32


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """Every key above the share, and a bounded number of lighter ones."""
    row = df.select(key).where(F.col(key).isNotNull()).stat.freqItems([key], share).first()
    return [] if row is None or row[0] is None else list(row[0])


def salted_aggregate(df: DataFrame, keys: list[str], heavy_on: str, row_hash: Column, partial: dict[str, Column], merge: dict[str, Column], salts: int = SALTS, heavy: list | None = None) -> DataFrame:
    """Group by ``keys`` without a task that holds all rows of a heavy key.

    ``partial`` names the first-stage aggregates, computed per (keys, salt), and
    ``merge`` turns their columns into the result per key. The salt is taken from
    ``row_hash``, so a task that is run again sends each row to the same group.
    Light keys all have salt 0 and cost what a plain aggregation costs. Null keys
    form a group of their own, as in GROUP BY.
    """
    heavy = heavy_keys(df, heavy_on) if heavy is None else heavy
    salt = F.when(F.col(heavy_on).isin(heavy), F.pmod(row_hash, F.lit(salts))).otherwise(0) if heavy else F.lit(0)
    first = df.withColumn("_salt", salt.cast("int")).groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])


def salted_join(many: DataFrame, one: DataFrame, on: str, heavy: list, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """many joined with one, in which each key has few rows, without a task that holds all rows of a heavy key.

    The rows of a heavy key are spread over ``salts`` groups by a hash of the row; its partners are repeated for each.
    """
    if not heavy:
        return many.join(one, on, how)
    salt = F.when(F.col(on).isin(heavy), F.pmod(F.xxhash64(*many.columns), F.lit(salts))).otherwise(0)
    copies = F.explode(F.when(F.col(on).isin(heavy), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return many.withColumn("_salt", salt.cast("int")).join(one.withColumn("_salt", copies), [on, "_salt"], how).drop("_salt")


def prefix_sums(df: DataFrame, by: list[str], order: list, value: str, name: str) -> DataFrame:
    """df with the sum of ``value`` over the rows before in each row's group, without a task that sorts a whole group.

    The rows are cut into ranges by group and order, summed inside a range, and raised by what the ranges before
    hold of the group: one number per range and group. The order must tell rows apart; null keys are a group.
    """
    kept = Scratch(df.sparkSession, "ranges")
    cut = kept.put(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id()), "cut")
    sums = cut.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_range"]
    sums = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(sums, same).select(*cut.columns, "_before")
    return out.withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_before", "_range")


def ranked(df: DataFrame, by: list[str], order: list, name: str = "place") -> DataFrame:
    """df with the place of each row in its group, from 1, by ranges as in prefix_sums."""
    return prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), by, order, "_one", name).drop("_one").withColumn(name, F.col(name) + 1)


def reference_counts(chunks: DataFrame) -> DataFrame:
    """References and distinct referring chunks of every id in calls and called_by.

    Input: chunk rows with id, indexed_at, calls, called_by; only current rows
    count. Output: side, key_id, n_references, n_chunks. Null arrays, null
    elements and null ids refer to nothing; a chunk that names an id twice adds two references and
    one chunk. An empty table gives no rows; further columns are ignored.
    """
    ids = chunks.select("id", "indexed_at", F.col("calls.id").alias("calls"), F.col("called_by.id").alias("called_by"))
    cur = current(ids, ["calls", "called_by"])
    sides = cur.select("id", F.explode(F.array(F.struct(F.lit("calls").alias("side"), F.col("calls").alias("ids")), F.struct(F.lit("called_by").alias("side"), F.col("called_by").alias("ids")))).alias("s"))
    refs = sides.select("id", "s.side", F.col("s.ids").alias("ids"), F.posexplode("s.ids").alias("pos", "key_id")).where("key_id is not null")
    # within a row the first mention stands for the chunk, so distinct chunks are a sum and combine before the shuffle
    refs = refs.select("side", "key_id", "id", "pos", (F.array_position("ids", F.col("key_id")) == F.col("pos") + 1).cast("long").alias("first"))
    # a first look over the rows as they lie, old versions too: a salt changes where rows go, not what comes out. Both sides
    # together, because a task is long only if its key is heavy among all rows
    heavy = heavy_keys(ids.select(F.explode(F.concat(*[F.coalesce(c, F.array().cast("array<bigint>")) for c in ("calls", "called_by")])).alias("key_id")), "key_id")
    return salted_aggregate(
        refs, ["side", "key_id"], "key_id", F.xxhash64("id", "pos"),
        {"n": F.count(F.lit(1)), "c": F.sum("first")}, {"n_references": F.sum("n"), "n_chunks": F.sum("c")}, heavy=heavy,
    )


def dominant_keys(counts: DataFrame, share: float = 0.03) -> DataFrame:
    """side, key_id of the ids that make up at least ``share`` of their side's references."""
    totals = counts.groupBy("side").agg(F.sum("n_references").alias("total"))  # two rows
    return counts.join(F.broadcast(totals), "side").where(F.col("n_references") >= share * F.col("total")).select("side", "key_id")
