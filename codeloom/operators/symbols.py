"""What is known around a symbol: hierarchy, relations, impact, whole searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import search as S


def class_edges(edges: DataFrame) -> DataFrame:
    """collection, edge, child, parent: the inherits and implements edges, one of each, with trimmed lower-case names; rows without a name are no edges."""
    e = edges.where(F.col("edge").isin("inherits", "implements")).select(F.col("src_collection").alias("collection"), "edge", F.lower(F.trim("child_name")).alias("child"), F.lower(F.trim("parent_name")).alias("parent"))
    return e.where("child <> '' and parent <> '' and child <> parent").distinct()


def type_card(hierarchy: DataFrame, edges: DataFrame) -> DataFrame:
    """collection, name, ancestors (nearest first), children, grandchildren, implements, implementers, note: what belongs to a type.

    ``hierarchy`` has collection, name, trail; ``edges`` as in class_edges. Lists are sorted sets, null for none; grandchildren are counted by
    joining links, so a root's descendants are listed two levels deep only. note says so if nothing is known.
    """
    inh, imp = edges.where("edge = 'inherits'"), edges.where("edge = 'implements'")
    key = ["collection", "name"]
    names = lambda df, by, of, c: df.groupBy("collection", F.col(by).alias("name")).agg(F.array_join(F.array_sort(F.collect_set(of)), ",").alias(c))
    two = inh.select("collection", F.col("parent").alias("top"), F.col("child").alias("mid")).join(inh.select("collection", F.col("parent").alias("mid"), "child"), ["collection", "mid"])
    h = hierarchy.select(*key, F.when(F.size("trail") > 1, F.array_join(F.slice("trail", F.lit(2), F.size("trail") - 1), ",")).alias("ancestors"))
    out = h.join(names(inh, "parent", "child", "children"), key, "left").join(names(two, "top", "child", "grandchildren"), key, "left")
    out = out.join(names(imp, "child", "parent", "implements"), key, "left").join(names(imp, "parent", "child", "implementers"), key, "left")
    return out.withColumn("note", F.when(F.coalesce("ancestors", "children", "implements", "implementers").isNull(), "no relations known"))


def relations(chunks: DataFrame, edges: DataFrame, same_unit: int = 200) -> DataFrame:
    """collection, id, kind (calls, called_by, same_unit), other, place: what a method is related to; of its unit at most ``same_unit`` others, by line.

    ``edges`` has collection, caller_id, callee_id. Only the first ``same_unit`` + 1 chunks of a unit are candidates, so a large unit is no square.
    """
    m = chunks.where("kind = 'method'").select("collection", "unit", "id")
    calls = edges.select("collection", F.col("caller_id").alias("id"), F.lit("calls").alias("kind"), F.col("callee_id").alias("other"))
    by = edges.select("collection", F.col("callee_id").alias("id"), F.lit("called_by").alias("kind"), F.col("caller_id").alias("other"))
    both = calls.union(by).withColumn("place", F.row_number().over(Window.partitionBy("collection", "id", "kind").orderBy("other")))
    line = Window.partitionBy("collection", "unit").orderBy(F.coalesce("line_start", F.lit(0)), "id")
    first = chunks.select("collection", "unit", F.col("id").alias("other"), F.row_number().over(line).alias("n")).where(F.col("n") <= same_unit + 1)
    own = first.select("collection", "unit", F.col("other").alias("id"), F.col("n").alias("own"))
    near = m.join(first, ["collection", "unit"]).where("id <> other").join(own, ["collection", "unit", "id"], "left")
    near = near.withColumn("place", F.col("n") - F.when(F.col("own") < F.col("n"), 1).otherwise(0)).where(F.col("place") <= same_unit)
    return both.unionByName(near.select("collection", "id", F.lit("same_unit").alias("kind"), "other", "place"))


def impact_two_levels(changed: DataFrame, chunks: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """collection, id, reason, level: what a change of units (collection, unit) reaches outside them.

    ``caller`` (level 1): chunks that call a changed method; ``subtype``: types one or two steps below a changed type. links has collection, child, parent.
    """
    hit = chunks.join(changed.select("collection", "unit").distinct(), ["collection", "unit"], "left_semi").select("collection", "id", "kind", F.lower(F.trim("name")).alias("name"))
    callers = edges.join(hit.where("kind = 'method'").select("collection", F.col("id").alias("callee_id")), ["collection", "callee_id"], "left_semi").select("collection", F.col("caller_id").alias("id"), F.lit("caller").alias("reason"), F.lit(1).alias("level"))
    one = links.join(hit.where("kind = 'type'").select("collection", F.col("name").alias("parent")).distinct(), ["collection", "parent"], "left_semi").select("collection", F.col("child").alias("name"), F.lit(1).alias("level"))
    two = links.join(one.select("collection", F.col("name").alias("parent")).distinct(), ["collection", "parent"], "left_semi").select("collection", F.col("child").alias("name"), F.lit(2).alias("level"))
    types = chunks.where("kind = 'type'").groupBy("collection", F.lower(F.trim("name")).alias("name")).agg(F.min("id").alias("id"))
    subs = one.union(two).groupBy("collection", "name").agg(F.min("level").alias("level")).join(types, ["collection", "name"]).select("collection", "id", F.lit("subtype").alias("reason"), "level")
    return callers.union(subs).groupBy("collection", "id", "reason").agg(F.min("level").alias("level")).join(hit.select("collection", "id"), ["collection", "id"], "left_anti")


def full_search(lists: DataFrame, chunks: DataFrame, queries: DataFrame, stars: DataFrame, scores: DataFrame, unit: str | None = None, offset: int = 0, k: int = 8, rerank: bool = True) -> DataFrame:
    """The page of every query: q_id, place, id, collection, unit, kind, name, line_start, code (1800 characters), doc, score, total, has_more and why (ranks, boosts, probability).

    ``lists`` has q_id, source, id, rank; ``queries`` q_id, q_text, expand (more words, which count for the boost, not for the re-ranking; may be null); ``stars`` collection, stars; ``scores`` id, combined.
    Fuse, boost by name, priority (only if the search spans several collections) and compared scores; order; filter by unit after that;
    drop declarations of listed methods; re-rank the first 50; spread units; cut the page. Lists must be as long as max(200, offset + k).
    """
    f = S.fuse(lists).join(chunks, "id")
    several = chunks.select("collection").distinct().limit(2).agg((F.count(F.lit(1)) > 1).alias("several"))  # one row
    q = queries.select("q_id", T.identifier_tokens(F.concat_ws(" ", "q_text", "expand")).alias("q_tokens"), T.identifier_tokens(F.col("q_text")).alias("raw_tokens"))
    f = f.join(q, "q_id").join(stars, "collection", "left").join(scores, "id", "left").join(F.broadcast(several))
    f = f.withColumn("name_boost", T.name_boost(F.col("q_tokens"), T.identifier_tokens(F.col("name")))).withColumn("multiplier", T.score_multiplier(F.col("combined")))
    f = f.withColumn("priority_boost", F.when(F.col("several"), T.priority_boost(F.col("stars"))).otherwise(1.0))
    f = f.withColumn("score", F.col("score") * F.col("name_boost") * F.col("priority_boost") * F.col("multiplier"))
    r = S.rank_fused(f, [F.asc("collection")])
    if unit is not None:
        r = r.where(F.lower("unit").contains(unit.lower()))
    again = lambda df, order: df.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(order)))
    r = again(S.drop_declared(r), "rank")
    if rerank:
        words = T.identifier_tokens(F.concat_ws(" ", "name", "doc"))
        logit = 4.0 * F.size(F.array_intersect("raw_tokens", words)) / F.greatest(F.size("raw_tokens"), F.lit(1)) - 2.0
        r = again(S.rerank(r, logit, F.col("name_boost"), F.col("multiplier")).drop("rank"), "new_rank").drop("new_rank").withColumn("rerank_prob", F.when(F.col("rerank_score").isNotNull(), F.round(T.sigmoid(logit), 3)))
    r = again(S.diversify(r).drop("rank"), "new_rank")
    p = S.page(r, offset, k)
    return p.select(
        "q_id", F.col("rank").alias("place"), "id", "collection", "unit", "kind", "name", "line_start", F.substring("code", 1, 1800).alias("code"), "doc", F.round("score", 6).alias("score"), "total", "has_more",
        "dense_rank", "sparse_rank", F.round("name_boost", 2).alias("name_boost"), F.round("priority_boost", 2).alias("priority_boost"), F.round("multiplier", 3).alias("cmp_boost"), *(["rerank_prob"] if rerank else []),
    )


def near_pairs(links: DataFrame, units: DataFrame, top: int | None = None) -> DataFrame:
    """id_a, id_b, score, same_unit of unordered pairs from links (q_id, id, score): each once, with its best score; with ``top`` the best so many, ties by id."""
    p = links.where("q_id <> id").groupBy(F.least("q_id", "id").alias("id_a"), F.greatest("q_id", "id").alias("id_b")).agg(F.max("score").alias("score"))
    u = units.select(F.col("id").alias("_i"), "unit")
    p = p.join(u.select(F.col("_i").alias("id_a"), F.col("unit").alias("ua")), "id_a", "left").join(u.select(F.col("_i").alias("id_b"), F.col("unit").alias("ub")), "id_b", "left")
    p = p.select("id_a", "id_b", "score", F.coalesce(F.col("ua") == F.col("ub"), F.lit(False)).alias("same_unit"))
    return p if top is None else p.orderBy(F.desc("score"), "id_a", "id_b").limit(top)


def chapters(chunks: DataFrame) -> DataFrame:
    """collection, chapter, n_units, n_types, n_untyped, sections: units by their first folder, sorted without regard to case; a unit without a type is untyped."""
    u = chunks.groupBy("collection", "unit").agg(F.count_if(F.col("kind") == "type").alias("types"))
    u = u.withColumn("chapter", T.chapter_key(F.col("unit")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("unit").alias("l"), "unit"))), lambda x: x["unit"]), ",")
    return u.groupBy("collection", "chapter").agg(F.count(F.lit(1)).alias("n_units"), F.sum("types").alias("n_types"), F.count_if(F.col("types") == 0).alias("n_untyped"), listed.alias("sections"))


def glob_rows(df: DataFrame, column: Column, suffixes: list[str]) -> DataFrame:
    """The rows whose path ends with one of the suffixes, in any case; none if there are no suffixes."""
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.lower(column).endswith(s.lower())
    return df.where(ends)
