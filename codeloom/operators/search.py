"""Retrieval and ranking over postings and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.skew import heavy_keys, salted_join
from codeloom.session import Scratch

K1, B = 1.2, 0.75
POOL = 200
#: a query matrix of at most this many numbers goes to every task; beyond it the queries go in blocks of this size
MAX_MATRIX = 4_000_000


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case; the dotted capital I counts as i, so it doesn't fall apart."""
    return F.regexp_extract_all(F.lower(F.translate(F.coalesce(c, F.lit("")), "İ", "i")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """term, doc_id, tf, len of each word of each document; documents without words have no rows."""
    d = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("t"))
    # counted inside the document's row: no shuffle
    d = d.withColumn("len", F.size("t")).withColumn("u", F.array_sort("t"))
    return d.select("doc_id", "len", F.explode("u").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def bm25(docs: DataFrame, queries: DataFrame, top: int = POOL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """q_id, doc_id, score, rank: textbook BM25 of the queries (q_id, q_text) against all documents.

    Only terms of the queries are shuffled. ``top`` must cover the page that is shown: max(POOL, offset + k). Equal scores (to 6 digits) are ranked by doc_id; a query without known words finds nothing.
    """
    q = queries.select("q_id", F.explode(F.array_distinct(tokens(F.col("q_text")))).alias("term"))
    d = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("t"))
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avgdl"))
    tf = d.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    tf = Scratch(docs.sparkSession, "postings").put(tf.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len")), "tf")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # the postings of common words are salted
    s = salted_join(tf, q.join(df, "term"), "term", heavy_keys(tf, "term")).join(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    s = s.groupBy("q_id", "doc_id").agg(F.round(F.sum(w), 6).alias("score"))
    return top_k(s, ["q_id"], [F.desc("score"), F.asc("doc_id")], top)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """With a rank from 1; per group only k rows leave each task."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def knn(vectors: DataFrame, queries: DataFrame, top: int | None, min_score: float | None = None, drop_self: bool = False, max_matrix: int = MAX_MATRIX) -> DataFrame:
    """q_id, id, score, rank: exact cosine neighbours of a stated query set (q_id, v) among all vectors (id, v).

    Without ``top`` every neighbour of at least min_score comes, and no rank: nothing is cut or shuffled.

    Queries go to the tasks as matrices of a bounded size; each task keeps its best of every batch, so few rows are shuffled.
    A query meets the vectors of its own length, so queries of several lengths don't disturb each other. Null, empty and
    zero vectors are no one's neighbours. Equal scores (6 digits) are ranked by id.
    """
    q = queries.where("q_id is not null and v is not null and size(v) > 0").select("q_id", "v")
    # one row per length of the queries; a length beyond the bound goes in blocks
    sizes = q.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()
    spark, out = vectors.sparkSession, None
    whole = sum(r["dim"] * r["n"] for r in sizes)
    parts = [(None, 1, 0)] if whole <= max_matrix else [(r["dim"], k, i) for r in sizes for k in [max(1, -(-r["dim"] * r["n"] // max_matrix))] for i in range(k)]
    for dim, blocks, i in parts:
        part = q if dim is None else q.where((F.size("v") == dim) & (F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == i))
        shared = spark.sparkContext.broadcast(_by_length(part.toPandas()))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                length = b["v"].map(lambda v: 0 if v is None else len(v))
                for dim, (m, ids) in shared.value.items():
                    rows = b[length == dim]
                    if not len(rows):
                        continue
                    x = np.array(rows["v"].tolist(), float)
                    norm = np.linalg.norm(x, axis=1)
                    keep = norm > 0
                    x, own = x[keep] / norm[keep, None], rows["id"].to_numpy()[keep]
                    if not len(own):
                        continue
                    s = np.round(m @ x.T, 6)
                    if drop_self:
                        s[ids[:, None] == own[None, :]] = -2
                    keep = s >= (-1.5 if min_score is None else min_score)
                    if top is not None:  # the k best of the batch, and all that tie with the last of them
                        keep &= s >= np.partition(s, max(0, s.shape[1] - top), axis=1)[:, max(0, s.shape[1] - top)][:, None]
                    a, c = np.nonzero(keep)
                    yield pd.DataFrame({"q_id": ids[a], "id": own[c], "score": s[a, c]})

        got = vectors.select("id", "v").where("id is not null").mapInPandas(score, "q_id bigint, id bigint, score double")
        out = got if out is None else out.union(got)
    return out if top is None else top_k(out, ["q_id"], [F.desc("score"), F.asc("id")], top)


def _by_length(rows: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> unit vectors and ids; without zero vectors."""
    out = {}
    for dim, g in rows.groupby(rows["v"].map(len)):
        m = np.array(g["v"].tolist(), float).reshape(len(g), dim)
        norm = np.linalg.norm(m, axis=1)
        if (norm > 0).any():
            out[int(dim)] = (m[norm > 0] / norm[norm > 0, None], g["q_id"].to_numpy()[norm > 0])
    return out


def fuse(lists: DataFrame, weights: dict[str, float] = T.WEIGHTS) -> DataFrame:
    """q_id, id, score, dense_rank, sparse_rank from ranked lists (q_id, source, id, rank): sum of weight / (60 + rank)."""
    w = F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in weights.items()])
    at = lambda s: F.min(F.when(F.col("source") == s, F.col("rank"))).alias(f"{s}_rank")
    return lists.where(F.col("source").isin(list(weights))).groupBy("q_id", "id").agg(F.sum(w / (T.RRF_K + F.col("rank"))).alias("score"), at("dense"), at("sparse"))


def mode_weights(mode: str) -> dict[str, float]:
    """dense or sparse alone with weight 1; any other mode means both."""
    return {mode: 1.0} if mode in T.WEIGHTS else dict(T.WEIGHTS)


def rank_fused(fused: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """With a rank by score; ties by dense rank, sparse rank, id."""
    far = F.lit(2**31 - 1)
    order = [F.desc(F.round("score", 9)), *(extra or []), F.coalesce("dense_rank", far), F.coalesce("sparse_rank", far), F.asc("id")]
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(*order)))


def page(ranked: DataFrame, offset: int, k: int) -> DataFrame:
    """The page's rows with total and has_more of their query."""
    total = F.count(F.lit(1)).over(Window.partitionBy("q_id"))
    return ranked.withColumn("total", total).withColumn("has_more", F.col("total") > offset + k).where((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def drop_declared(ranked: DataFrame) -> DataFrame:
    """A decl goes if a method with the same collection, unit and bare name is in the list; a method without doc inherits that of the lowest-ranked documented decl.

    Input: q_id, rank, collection, unit, name, kind, doc. Null names are names of their own.
    """
    w = Window.partitionBy("q_id", "collection", "unit", "bare")
    r = ranked.withColumn("bare", T.bare_name(F.col("name")))
    documented = (F.col("kind") == "decl") & (F.trim(F.coalesce("doc", F.lit(""))) != "")
    r = r.withColumn("has_method", F.max((F.col("kind") == "method").cast("int")).over(w)).withColumn("decl_doc", F.max_by(F.when(documented, F.col("doc")), F.when(documented, F.col("rank"))).over(w))
    doc = F.when((F.col("kind") == "method") & (F.trim(F.coalesce("doc", F.lit(""))) == ""), F.coalesce("decl_doc", "doc")).otherwise(F.col("doc"))
    return r.withColumn("doc", doc).where((F.col("kind") != "decl") | (F.col("has_method") == 0)).drop("has_method", "decl_doc", "bare")


def diversify(ranked: DataFrame, head: int = 24, per_unit: int = 3) -> DataFrame:
    """new_rank: in the first ``head`` places at most ``per_unit`` of a unit; the rest follow in order, none is dropped."""
    u = F.row_number().over(Window.partitionBy("q_id", "unit").orderBy("rank"))
    r = ranked.withColumn("u", u)
    before = Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("c", F.coalesce(F.sum((F.col("u") <= per_unit).cast("int")).over(before), F.lit(0)))
    r = r.withColumn("demoted", (F.col("u") > per_unit) & (F.col("c") < head))
    return r.withColumn("new_rank", F.row_number().over(Window.partitionBy("q_id").orderBy("demoted", "rank"))).drop("u", "c")


def rerank(ranked: DataFrame, logit: Column, boost: Column, multiplier: Column, pool: int = 50) -> DataFrame:
    """new_rank: the first ``pool`` by sigmoid(logit) * boost * multiplier * 5 / (5 + place), the others behind in order."""
    prob = F.when(F.col("rank") <= pool, F.round(T.sigmoid(logit) * boost * multiplier * 5 / (5 + F.col("rank") - 1), 9))
    r = ranked.withColumn("rerank_score", prob)
    return r.withColumn("new_rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank")))
