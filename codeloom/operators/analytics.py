"""Usage analytics, retrieval quality and censuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.skew import prefix_sums


def usage(log: DataFrame, last_hours: int = 24) -> DataFrame:
    """mode, n, n_zero, avg_ms, n_recent of a search log (mode, ms, zero, at), with a total row (mode null); recent is counted back from the newest entry."""
    newest = log.agg(F.max("at").alias("newest"))  # one row
    l = log.join(F.broadcast(newest)).withColumn("recent", F.col("at") > F.col("newest") - F.expr(f"interval {last_hours} hours"))
    return l.rollup("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if("zero").alias("n_zero"), F.round(F.avg("ms"), 6).alias("avg_ms"), F.count_if("recent").alias("n_recent"))


def top_counts(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """The k most frequent values; ties by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(col)).limit(k)


def retrieval_metrics(results: DataFrame, golden: DataFrame, k: int = 8) -> DataFrame:
    """collection, questions, recall, mrr, ndcg with a row over all (collection null).

    ``results`` has q_id, rank, hit_name; ``golden`` has q_id, collection, expected (names). A hit counts if its name contains an expected one, in any case. A
    question without a hit has 0 in all; nDCG is for one relevant hit: 1 / log2(1 + rank of the first).
    """
    hits = results.where(F.col("rank") <= k).join(golden, "q_id").where(F.exists("expected", lambda x: (F.length(x) > 0) & F.contains(F.lower("hit_name"), F.lower(x))))
    first = hits.groupBy("q_id").agg(F.min("rank").alias("r"))
    g = golden.select("q_id", "collection").dropDuplicates(["q_id"]).join(first, "q_id", "left")
    hit = F.col("r").isNotNull().cast("double")
    return g.rollup("collection").agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.avg(hit), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.coalesce(1 / F.log2(1 + F.col("r")), F.lit(0.0))), 6).alias("ndcg"),
    )


def latency(log: DataFrame, by: str, ms: str) -> DataFrame:
    """by, p50 (median) and p95 (the value at place max(0, floor(0.95 n) - 1) from 0).

    Values are ranked as counts of equal ones by ranges, so no task sorts all rows of a group. Null values don't count.
    """
    counts = log.where(F.col(ms).isNotNull()).groupBy(by, ms).agg(F.count(F.lit(1)).alias("c"))
    r = prefix_sums(counts, [by], [F.col(ms)], "c", "before")
    # few groups, but nothing bounds them: the optimizer decides how to join
    n = counts.groupBy(F.col(by).alias("_by")).agg(F.sum("c").alias("n"))
    r = r.join(n, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    at = lambda i: F.max(F.when((F.col("before") <= i) & (F.col("before") + F.col("c") > i), F.col(ms)))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    return r.groupBy(by).agg(((at(low) + at(high)) / 2).alias("p50"), at(F.greatest(F.lit(0), F.floor(F.col("n") * 95 / 100) - 1)).alias("p95"))


def census(files: DataFrame, by: list[str], label: Column, top: int = 2) -> DataFrame:
    """by..., label, n, percent: the most frequent labels of each group, ties by label; percent is rounded half up."""
    g = files.withColumn("label", label).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("percent", F.floor(100 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)) + 0.5).cast("int"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("label"))
    return g.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def sessions(events: DataFrame, user: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """user, session_start, session_end (of the last event), n_events."""
    e = events.where(F.col(user).isNotNull() & F.col(at).isNotNull())
    return e.groupBy(user, F.session_window(at, gap)).agg(F.min(at).alias("session_start"), F.max(at).alias("session_end"), F.count(F.lit(1)).alias("n_events")).drop("session_window")
