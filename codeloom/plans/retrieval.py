"""Search queries: text, vectors, fusion, ranking. Query sets are the rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.model import table
from codeloom.operators import search as S
from codeloom.plans.common import CUR, cur, wide


def tokenize_names(spark, d):
    n = table(spark, d, "chunks").select("name").distinct()
    return n.select("name", F.array_join(F.array_sort(T.identifier_tokens(F.col("name"))), " ").alias("tokens"))


def name_boost(spark, d):
    """The names of a question's collection that share a word with it, with their boost."""
    q = table(spark, d, "eval_items").select("item_id", "collection", T.identifier_tokens(F.col("question")).alias("q")).distinct()
    n = table(spark, d, "chunks").select("collection", "name").where("name is not null").distinct().withColumn("n", T.identifier_tokens(F.col("name")))
    j = q.join(n, "collection").where(F.arrays_overlap("q", "n"))
    return j.select("item_id", "name", F.round(T.name_boost(F.col("q"), F.col("n")), 6).alias("boost"))


def scalar_text(spark, d):
    c = table(spark, d, "chunks").select("unit", "name").distinct()
    p = F.translate("unit", "\\", "/")
    return c.select("unit", "name", T.bare_name(F.col("name")).alias("bare"), T.before_equals(F.col("name")).alias("head"), T.slug(F.col("name")).alias("slug"), T.chapter_key(p).alias("chapter"), T.stem(p).alias("stem"), T.suffix(p).alias("suffix"))


def term_postings(spark, d):
    p = S.postings(table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("len").cast("bigint").alias("longest"))


def _passages(spark, d):
    return table(spark, d, "eval_items").where("item_id % 100 = 0").select(F.col("item_id").alias("q_id"), F.col("passage").alias("q_text"))


def sparse_search(spark, d):
    return wide(S.bm25(table(spark, d, "documents"), _passages(spark, d)))


def _vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v, v.where("id % 100 = 0").select(F.col("id").alias("q_id"), "v")


def dense_knn(spark, d):
    return wide(S.knn(*_vectors(spark, d), top=10))


def find_similar(spark, d):
    return wide(S.knn(*_vectors(spark, d), top=8, drop_self=True))


def similar_above(spark, d):
    """Every link of at least 0.3 from the query set to all rows."""
    return wide(S.knn(*_vectors(spark, d), top=None, min_score=0.3, drop_self=True))


def _lists(spark, d):
    """Dense and sparse lists of documents, for the documents with a vector whose id is divisible by 100; the sparse query is the whole text."""
    docs = table(spark, d, "documents")
    v, q = _vectors(spark, d)
    texts = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("q_id"), F.col("text").alias("q_text")).join(q.select("q_id"), "q_id", "left_semi")
    dense = S.knn(v.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi"), q.join(docs.select(F.col("doc_id").alias("q_id")), "q_id", "left_semi"), top=S.POOL)
    sparse = S.bm25(docs, texts)
    return dense.select("q_id", F.lit("dense").alias("source"), "id", "rank").union(sparse.select("q_id", F.lit("sparse").alias("source"), F.col("doc_id").alias("id"), "rank"))


def hybrid_rrf(spark, d):
    f = S.rank_fused(S.fuse(_lists(spark, d)))
    return wide(S.page(f, 0, 8).select("q_id", "id", F.round("score", 6).alias("score"), "dense_rank", "sparse_rank", "rank", "total", "has_more"))


def hybrid_modes(spark, d):
    lists, out = _lists(spark, d), None
    for mode in ("dense", "sparse", "anything"):
        r = S.rank_fused(S.fuse(lists, S.mode_weights(mode))).where("rank <= 5").select(F.lit(mode).alias("mode"), "q_id", "id", "rank")
        out = r if out is None else out.union(r)
    return wide(out)


def _hits(spark, d, where="true"):
    """Chunks found for the passages, best first, with their columns."""
    c = cur(spark, d).where(where)
    h = S.bm25(c.select("id", F.concat_ws(" ", "name", "doc", "code").alias("body")), _passages(spark, d), doc_id="id", text="body").withColumnRenamed("doc_id", "id")
    return h.join(c, "id")


def search_filters(spark, d):
    """Kind and language are pushed below the search; the unit is looked at after the best 200."""
    h = _hits(spark, d, "kind = 'method' and lang is null")
    return wide(h.where(F.lower("unit").contains("src")).select("q_id", "id", "rank", "unit"))


def _stars(spark, d):
    return table(spark, d, "profiles").groupBy("collection").agg(F.max("priority").alias("stars"))


def priority_boost(spark, d):
    h = _hits(spark, d).join(_stars(spark, d), "collection", "left")
    s = F.round(T.priority_boost(F.col("stars")) / (T.RRF_K + F.col("rank")), 9)
    return wide(S.top_k(h.select("q_id", "id", "collection", s.alias("score")), ["q_id"], [F.desc("score"), F.asc("id")], 20))


def compare_multiplier(spark, d):
    return table(spark, d, "events").select("event_id", F.round(T.score_multiplier(F.col("value")), 6).alias("multiplier"))


def decl_dedup(spark, d):
    return wide(S.drop_declared(_hits(spark, d)).select("q_id", "rank", "id", "kind", "doc"))


def diversify(spark, d):
    return wide(S.diversify(_hits(spark, d)).select("q_id", "id", "unit", "rank", "new_rank"))


def rerank_blend(spark, d):
    """The scorer's place is taken by a logit from the share of the passage's words that a chunk's name and doc hold."""
    p = _passages(spark, d).select("q_id", S.tokens(F.col("q_text")).alias("q"))
    h = _hits(spark, d).join(p, "q_id")
    words = S.tokens(F.concat_ws(" ", "name", "doc"))
    logit = 4.0 * F.size(F.array_intersect(F.array_distinct("q"), words)) / F.size(F.array_distinct("q")) - 2.0
    boost = T.name_boost(F.array_distinct("q"), T.identifier_tokens(F.col("name")))
    return wide(S.rerank(h, logit, boost, F.lit(1.0)).select("q_id", "id", "rank", F.round("rerank_score", 6).alias("rerank_score"), "new_rank"))


def paginate(spark, d):
    return wide(S.page(_hits(spark, d), 10, 10).select("q_id", "id", "rank", "total", "has_more"))


QUERIES = {f.__name__: f for f in (tokenize_names, name_boost, scalar_text, term_postings, sparse_search, dense_knn, find_similar, similar_above, hybrid_rrf, hybrid_modes, search_filters, priority_boost, compare_multiplier, decl_dedup, diversify, rerank_blend, paginate)}

_IDENT = r"list_distinct(regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce({0}, ''), '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}}+)(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')), '[\p{{L}}\p{{N}}]+'))"
_TOK = r"regexp_extract_all(lower(replace(coalesce({0}, ''), 'İ', 'i')), '[\p{{L}}\p{{N}}]+')"
_BOOST = "CASE WHEN len(list_intersect({q}, {n})) > 0 THEN 1 + 2 * (len(list_intersect({q}, {n}))::DOUBLE / len({q})) * (0.5 + 0.5 * len(list_intersect({q}, {n}))::DOUBLE / len({n})) ELSE 1.0 END"


def _bm25(docs: str, queries: str, top: int = 200, p: str = "") -> str:
    return f"""{p}tok AS (SELECT id, {_TOK.format("body")} AS t FROM ({docs})),
{p}qt AS (SELECT DISTINCT q_id, unnest({_TOK.format("q_text")}) AS term FROM ({queries})),
{p}stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {p}tok),
{p}tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM {p}tok) WHERE term IN (SELECT term FROM {p}qt) GROUP BY ALL),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
{p}sc AS (SELECT q_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {p}qt JOIN {p}tf USING (term) JOIN {p}df USING (term), {p}stats GROUP BY ALL),
{p}hits AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM {p}sc QUALIFY rank <= {top})"""


_PASSAGES = "SELECT item_id AS q_id, passage AS q_text FROM eval_items WHERE item_id % 100 = 0"
_COS = "round(list_cosine_similarity(q.v, x.v), 6)"
_VEC = "vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


def _knn(top: int, where: str = "true") -> str:
    return f"""WITH {_VEC} SELECT q.id AS q_id, x.id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.id ORDER BY {_COS} DESC, x.id) AS rank
FROM vec q, vec x WHERE q.id % 100 = 0 AND {where} QUALIFY rank <= {top}"""


def _fused(weights: str) -> str:
    return f"""SELECT q_id, id, sum(w / (60 + rank)) AS score, min(CASE WHEN source = 'dense' THEN rank END) AS dense_rank, min(CASE WHEN source = 'sparse' THEN rank END) AS sparse_rank
FROM lists JOIN (VALUES {weights}) AS t(source, w) USING (source) GROUP BY ALL"""


_LISTS = f"""{_VEC}, dv AS (SELECT * FROM vec WHERE id IN (SELECT doc_id FROM documents)),
dn AS (SELECT q.id AS q_id, x.id AS id, row_number() OVER (PARTITION BY q.id ORDER BY {_COS} DESC, x.id) AS rank FROM dv q, dv x WHERE q.id % 100 = 0 QUALIFY rank <= 200),
{_bm25("SELECT doc_id AS id, text AS body FROM documents", "SELECT doc_id AS q_id, text AS q_text FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT id FROM vec)")},
lists AS (SELECT q_id, 'dense' AS source, id, rank FROM dn UNION ALL SELECT q_id, 'sparse', id, rank FROM hits)"""
_ORDER = "ORDER BY round(score, 9) DESC, coalesce(dense_rank, 2147483647), coalesce(sparse_rank, 2147483647), id"
_BODY = "SELECT id, concat_ws(' ', name, doc, code) AS body FROM cur"
_HITS = f"WITH {CUR}, {_bm25(_BODY, _PASSAGES)}, found AS (SELECT * FROM hits JOIN cur USING (id))"

ORACLE = {
    "tokenize_names": f"SELECT name, array_to_string(list_sort({_IDENT.format('name')}), ' ') AS tokens FROM (SELECT DISTINCT name FROM chunks)",
    "name_boost": f"""WITH q AS (SELECT DISTINCT item_id, collection, {_IDENT.format("question")} AS q FROM eval_items), c AS (SELECT collection, name, {_IDENT.format("name")} AS n FROM (SELECT DISTINCT collection, name FROM chunks WHERE name IS NOT NULL))
SELECT item_id, name, round({_BOOST.format(q="q", n="n")}, 6) AS boost FROM q JOIN c USING (collection) WHERE len(list_intersect(q, n)) > 0""",
    "scalar_text": r"""WITH c AS (SELECT DISTINCT unit, name, replace(unit, '\', '/') AS p FROM chunks), f AS (SELECT *, regexp_extract(p, '[^/]*$') AS f,
regexp_replace(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM c)
SELECT unit, name, lower(trim(regexp_extract(name, '[^.]*$'))) AS bare, trim(split_part(name, '=', 1)) AS head, CASE WHEN s = '' THEN 'section' ELSE s END AS slug,
CASE WHEN p LIKE '%/%' THEN split_part(p, '/', 1) ELSE 'general' END AS chapter, regexp_replace(f, '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract(f, '.(\.[^.]*)$', 1)) AS suffix FROM f""",
    "term_postings": f"""WITH t AS (SELECT doc_id, {_TOK.format("text")} AS t FROM documents), p AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM t), g AS (SELECT term, doc_id, n, count(*) AS tf FROM p GROUP BY ALL)
SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf, max(n)::BIGINT AS longest FROM g GROUP BY term""",
    "sparse_search": f"WITH {_bm25('SELECT doc_id AS id, text AS body FROM documents', _PASSAGES)} SELECT q_id, id AS doc_id, score, rank FROM hits",
    "dense_knn": _knn(10),
    "find_similar": _knn(8, "q.id <> x.id"),
    "similar_above": f"WITH {_VEC} SELECT q.id AS q_id, x.id AS id, {_COS} AS score FROM vec q, vec x WHERE q.id % 100 = 0 AND q.id <> x.id AND {_COS} >= 0.3",
    "hybrid_rrf": f"""WITH {_LISTS}, f AS ({_fused("('dense', 1.0), ('sparse', 0.6)")}), r AS (SELECT *, row_number() OVER (PARTITION BY q_id {_ORDER}) AS rank, count(*) OVER (PARTITION BY q_id) AS total FROM f)
SELECT q_id, id, round(score, 6) AS score, dense_rank, sparse_rank, rank, total, total > 8 AS has_more FROM r WHERE rank <= 8""",
    "hybrid_modes": f"WITH {_LISTS} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, q_id, id, row_number() OVER (PARTITION BY q_id {_ORDER}) AS rank FROM ({_fused(w)}) QUALIFY rank <= 5" for m, w in (("dense", "('dense', 1.0)"), ("sparse", "('sparse', 1.0)"), ("anything", "('dense', 1.0), ('sparse', 0.6)"))),
    "search_filters": f"""WITH {CUR}, {_bm25(_BODY + " WHERE kind = 'method' AND lang IS NULL", _PASSAGES)} SELECT q_id, id, rank, unit FROM hits JOIN cur USING (id) WHERE lower(unit) LIKE '%src%'""",
    "priority_boost": f"""{_HITS}, s AS (SELECT q_id, id, collection, round((1 + 0.08 * coalesce(stars, 0)) / (60 + rank), 9) AS score FROM found LEFT JOIN (SELECT collection, max(priority) AS stars FROM profiles GROUP BY 1) USING (collection))
SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 20""",
    "compare_multiplier": "SELECT event_id, round(CASE WHEN value IS NULL THEN 1.0 ELSE 1 + 0.12 * (greatest(1.0, least(10.0, value)) - 5.5) / 4.5 END, 6) AS multiplier FROM events",
    "decl_dedup": f"""{_HITS}, k AS (SELECT *, lower(trim(regexp_extract(name, '[^.]*$'))) AS bare, kind = 'decl' AND trim(coalesce(doc, '')) <> '' AS documented FROM found),
w AS (SELECT *, max(CASE WHEN kind = 'method' THEN 1 ELSE 0 END) OVER g AS m, last_value(CASE WHEN documented THEN doc END IGNORE NULLS) OVER (PARTITION BY q_id, collection, unit, bare ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dd
  FROM k WINDOW g AS (PARTITION BY q_id, collection, unit, bare))
SELECT q_id, rank, id, kind, CASE WHEN kind = 'method' AND trim(coalesce(doc, '')) = '' THEN coalesce(dd, doc) ELSE doc END AS doc FROM w WHERE kind <> 'decl' OR m = 0""",
    "diversify": f"""{_HITS}, u AS (SELECT *, row_number() OVER (PARTITION BY q_id, unit ORDER BY rank) AS u FROM found),
c AS (SELECT *, coalesce(sum(CASE WHEN u <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY q_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM u)
SELECT q_id, id, unit, rank, row_number() OVER (PARTITION BY q_id ORDER BY (u > 3 AND c < 24), rank) AS new_rank FROM c""",
    "rerank_blend": f"""{_HITS}, p AS (SELECT q_id, list_distinct({_TOK.format("q_text")}) AS q FROM ({_PASSAGES})),
x AS (SELECT q_id, id, rank, q, {_IDENT.format("name")} AS n, len(list_intersect(q, list_distinct({_TOK.format("concat_ws(' ', name, doc)")}))) AS common FROM found JOIN p USING (q_id)),
s AS (SELECT *, CASE WHEN rank <= 50 THEN round(1 / (1 + exp(-(4.0 * common / len(q) - 2.0))) * {_BOOST.format(q="q", n="n")} * 5 / (5 + rank - 1), 9) END AS sc FROM x)
SELECT q_id, id, rank, round(sc, 6) AS rerank_score, row_number() OVER (PARTITION BY q_id ORDER BY sc DESC NULLS LAST, rank) AS new_rank FROM s""",
    "paginate": f"""{_HITS}, t AS (SELECT q_id, id, rank, count(*) OVER (PARTITION BY q_id) AS total FROM found) SELECT *, total > 20 AS has_more FROM t WHERE rank > 10 AND rank <= 20""",
}
