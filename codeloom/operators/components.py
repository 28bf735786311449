"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.skew import heavy_keys, salted_join
from codeloom.session import Scratch


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the least node) of an undirected graph a - b; nulls and loops are no links.

    Each round hooks every neighbour onto the least node around, until a round changes nothing. Neighbours are
    never collected, only minima are taken, and the edges of a hub are salted, so no task holds them all.
    """
    kept = Scratch(links.sparkSession, "components")
    e = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, turn = kept.put(e, "e0"), 0
    seen = _print(e)
    while True:
        # links point down, so hubs are among their ends
        hubs = heavy_keys(e, "b")
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = salted_join(both, least, "a", hubs).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = kept.put(large, f"large{turn}")
        # every node once towards its least lower neighbour; the other lower neighbours hang on that one too
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, low, "a", heavy_keys(large, "a")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        turn += 1
        new = kept.put(small, f"e{turn}")
        kept.drop(f"large{turn - 1}", f"e{turn - 1}")
        e, before, seen = new, seen, _print(new)
        if seen == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())


def _print(e: DataFrame) -> tuple:
    """What tells two sets of links apart: their number and two sums of hashes."""
    h = F.xxhash64("a", "b")
    return tuple(e.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(38,0)"))).first())
