"""Queries around symbols: hierarchies by name, relations, impact, whole searches, manual parts, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.model import file_path, table
from codeloom.operators import documents as D
from codeloom.operators import graph as G
from codeloom.operators import hierarchy as H
from codeloom.operators import lifecycle as L
from codeloom.operators import search as S
from codeloom.operators import symbols as Y
from codeloom.plans.common import CUR, cur, wide
from codeloom.plans.graphs import _EDGES, _U
from codeloom.plans.retrieval import _BOOST, _IDENT, _ORDER, _bm25, _fused
from codeloom.plans.reports import ORACLE as _REPORTS
from codeloom.plans.training import _TREE


def _chunks(spark, d):
    return cur(spark, d).withColumn("unit", file_path(F.col("unit")))


def class_edges(spark, d):
    return Y.class_edges(table(spark, d, "symbol_edges"))


def edge_counts(spark, d):
    """Types and edges of each collection's symbol graph."""
    e = Y.class_edges(table(spark, d, "symbol_edges"))
    n = e.select("collection", F.explode(F.array("child", "parent")).alias("t")).groupBy("collection").agg(F.count_distinct("t").alias("n_types"))
    return n.join(e.groupBy("collection").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("edge") == "implements").alias("n_implements")), "collection")


def first_edges(spark, d):
    """The 50 first edges of the table by id, once each."""
    return table(spark, d, "symbol_edges").select("edge_id", "edge", "child_name", "parent_name").distinct().orderBy("edge_id", "edge", "child_name", "parent_name").limit(50)


def type_cards(spark, d):
    h = H.type_hierarchy(table(spark, d, "chunks"), table(spark, d, "symbol_edges"))
    return Y.type_card(h.select(F.col("src_collection").alias("collection"), F.col("node_name").alias("name"), "trail"), Y.class_edges(table(spark, d, "symbol_edges")))


def relations(spark, d):
    c = _chunks(spark, d)
    return wide(Y.relations(c, G.call_edges(cur(spark, d))))


def impact_levels(spark, d):
    c = _chunks(spark, d)
    changed = c.where(F.lower(T.stem(F.col("unit"))).rlike("^[abc]")).select("collection", "unit").distinct()
    return wide(Y.impact_two_levels(changed, c, G.call_edges(cur(spark, d)), H.type_links(table(spark, d, "symbol_edges")).withColumnRenamed("src_collection", "collection")))


def unit_neighbours(spark, d):
    """Per unit stem, sorted sets of the stems it uses and is used by."""
    e = table(spark, d, "symbol_edges").where("edge = 'uses'").select(F.col("src_collection").alias("collection"), F.lower(F.trim("child_name")).alias("unit"), F.lower(F.trim("parent_name")).alias("target")).where("unit <> '' and target <> '' and unit <> target")
    sets = lambda by, of, c: e.groupBy("collection", F.col(by).alias("stem")).agg(F.array_join(F.array_sort(F.collect_set(of)), ",").alias(c))
    return sets("unit", "target", "uses").join(sets("target", "unit", "used_by"), ["collection", "stem"], "full")


def chunk_lookup(spark, d):
    """The rows of the ids that calls refer to, with what a look-up returns: code of 4,000 characters and whether it was cut."""
    ids = table(spark, d, "chunks").select(F.explode("calls.id").alias("id")).where("id is not null").distinct()
    c = cur(spark, d).join(ids, "id", "left_semi")
    return wide(c.select("id", "collection", "unit", "kind", "name", "line_start", F.md5(F.substring("code", 1, 4000)).alias("code"), (F.char_length("code") >= 4000).alias("truncated")))


def _questions(spark, d):
    """The names of chunks whose id is divisible by 100, as queries with their chunk's language as an expansion."""
    return cur(spark, d, ["name", "lang"]).where("id % 100 = 0").select(F.col("id").alias("q_id"), F.coalesce("name", F.lit("")).alias("q_text"), F.col("lang").alias("expand"))


def full_search(spark, d):
    """Search as a whole. The encoder's list is stood in for by BM25 over names and documentation; a fifth of the chunks have a compared score."""
    c, q = cur(spark, d), _questions(spark, d)
    body = S.bm25(c.select("id", F.concat_ws(" ", "name", "doc", "code").alias("body")), q, doc_id="id", text="body")
    head = S.bm25(c.select("id", F.concat_ws(" ", "name", "doc").alias("body")), q, doc_id="id", text="body")
    lists = head.select("q_id", F.lit("dense").alias("source"), F.col("doc_id").alias("id"), "rank").union(body.select("q_id", F.lit("sparse").alias("source"), F.col("doc_id").alias("id"), "rank"))
    stars = table(spark, d, "profiles").groupBy("collection").agg(F.max("priority").alias("stars"))
    scores = c.where("id % 5 = 0").select("id", (F.col("id") % 12).alias("combined"))
    p = Y.full_search(lists, c.select("id", "collection", "unit", "kind", "name", "line_start", "code", "doc"), q, stars, scores)
    return wide(p.withColumn("code", F.md5("code")).drop("rerank_prob", "name_boost", "priority_boost", "cmp_boost"))


def near_pairs(spark, d):
    """Pairs of the query set with all rows at 0.3 or more, once each; a document's collection stands for its unit."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    links = S.knn(v, v.where("id % 100 = 0").select(F.col("id").alias("q_id"), "v"), top=None, min_score=0.3, drop_self=True)
    return Y.near_pairs(links, table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("collection").alias("unit")))


def chapters(spark, d):
    return wide(Y.chapters(_chunks(spark, d).where("unit is not null")))


def script_files(spark, d):
    """Files whose path ends like a script, in any case."""
    return Y.glob_rows(_chunks(spark, d).select("collection", "unit").distinct(), F.col("unit"), [".js", ".PY"])


def zero_results(spark, d):
    """Queries that found nothing, and votes, per query: the 20 with most empty results; a vote is up or down, anything else is refused."""
    e = table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("q"), F.when(F.col("event_type") == "purchase", "up").when(F.col("event_type") == "error", "down").alias("verdict"), (F.col("event_type") == "error").alias("zero"))
    g = e.groupBy("q").agg(F.count_if("zero").alias("n_zero"), F.count_if(F.col("verdict") == "up").alias("up"), F.count_if(F.col("verdict") == "down").alias("down"))
    return g.orderBy(F.desc("n_zero"), F.asc_nulls_last("q")).limit(20)


def answer_cache(spark, d):
    """The newest answer to each question (trimmed, lower case) of a user, if it is younger than seven days at the end of the log."""
    e = table(spark, d, "events").select("user_id", F.lower(F.trim(F.get_json_object("props", "$.k"))).alias("key"), "event_id", "ts")
    newest = e.agg(F.max("ts").alias("now"))  # one row
    last = e.groupBy("user_id", "key").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return last.join(F.broadcast(newest)).where(F.col("m.ts") > F.col("now") - F.expr("interval 7 days")).select("user_id", "key", "m.event_id")


def compare_scores(spark, d):
    """Scores of the rows of each order's list by position from 1: clamped to 1..10, combined as their mean; positions that the order doesn't have are skipped."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("hits"))
    clamp = lambda c: F.greatest(F.lit(1.0), F.least(F.lit(10.0), c))
    given = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") + 1).alias("i"), clamp(F.col("l_quantity")).alias("a"), clamp(F.col("l_discount") * 100).alias("b"))
    at = rows.select("l_orderkey", F.posexplode("hits").alias("pos", "hit"))
    j = at.join(given, ["l_orderkey"]).where(F.col("i") == F.col("pos") + 1)
    return j.select("l_orderkey", F.col("i").cast("bigint").alias("i"), F.col("hit.l_partkey").alias("l_partkey"), F.round((F.col("a") + F.col("b")) / 2, 6).alias("combined"))


def index_run(spark, d):
    """The state of the later half of the indexing time over that of the earlier, by kind."""
    c = table(spark, d, "chunks").select("id", "indexed_at", "kind", F.col("code_hash").alias("h"))
    old = c.where("id % 3 <> 0").groupBy("id").agg(F.min_by(F.struct("kind", "h"), "indexed_at").alias("r")).select("id", "r.*")
    new = c.where("id % 7 <> 0").groupBy("id").agg(F.max_by(F.struct("kind", "h"), "indexed_at").alias("r")).select("id", "r.*")
    return L.index_run(old, new, "id", "h")[0].select("id", "kind", "h")


def merged_profiles(spark, d):
    """Profiles of collections with what their chunks say about the language: the profile's fields stay unless chunks give a value."""
    old = table(spark, d, "profiles").groupBy("collection").agg(F.min("lib").alias("lib"), F.min("main_lang").alias("main_lang"))
    new = cur(spark, d, ["collection", "lang"]).groupBy("collection").agg(F.max("lang").alias("main_lang")).withColumn("lib", F.lit(None).cast("string"))
    return L.merge_fields(old, new, ["collection"], ["lib", "main_lang"])


def block_html(spark, d):
    """Markdown blocks of all documents as HTML."""
    b = D.markdown_blocks(table(spark, d, "documents"))
    return wide(b.select("doc_id", "part", "pos", F.md5(T.block_html(F.col("kind"), F.col("content"))).alias("html")))


QUERIES = {f.__name__: f for f in (class_edges, edge_counts, first_edges, type_cards, relations, impact_levels, unit_neighbours, chunk_lookup, full_search, near_pairs, chapters, script_files, zero_results, answer_cache, compare_scores, index_run, merged_profiles, block_html)}

_BLOCKS = _REPORTS["markdown_blocks"]
_CLASS = "cls AS (SELECT DISTINCT src_collection AS collection, edge, lower(trim(child_name)) AS child, lower(trim(parent_name)) AS parent FROM symbol_edges WHERE edge IN ('inherits', 'implements') AND trim(child_name) <> '' AND trim(parent_name) <> '' AND lower(trim(child_name)) <> lower(trim(parent_name)))"
_SET = "array_to_string(list_sort(list_distinct(list({}))), ',')"
_Q = "SELECT id AS q_id, coalesce(name, '') AS q_text FROM cur WHERE id % 100 = 0"
_HEAD = "SELECT id, concat_ws(' ', name, doc) AS body FROM cur"
_BODY = "SELECT id, concat_ws(' ', name, doc, code) AS body FROM cur"
_ESC = "replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
ORACLE = {
    "class_edges": f"WITH {_CLASS} SELECT * FROM cls",
    "edge_counts": f"WITH {_CLASS}, t AS (SELECT collection, child AS t FROM cls UNION SELECT collection, parent FROM cls) SELECT collection, n_types, n_edges, n_implements FROM (SELECT collection, count(DISTINCT t) AS n_types FROM t GROUP BY 1) JOIN (SELECT collection, count(*) AS n_edges, count(*) FILTER (edge = 'implements') AS n_implements FROM cls GROUP BY 1) USING (collection)",
    "first_edges": "SELECT DISTINCT edge_id, edge, child_name, parent_name FROM symbol_edges ORDER BY edge_id, edge, child_name NULLS FIRST, parent_name NULLS FIRST LIMIT 50",
    "type_cards": f"""WITH RECURSIVE {_TREE}, {_CLASS},
up AS (SELECT t.src_collection, t.c, l.p AS at, [t.c, l.p] AS seen FROM types t JOIN link l ON l.src_collection = t.src_collection AND l.c = t.c WHERE l.p <> t.c
  UNION ALL SELECT u.src_collection, u.c, l.p, list_append(u.seen, l.p) FROM up u JOIN link l ON l.src_collection = u.src_collection AND l.c = u.at WHERE NOT list_contains(u.seen, l.p)),
anc AS (SELECT src_collection AS collection, c AS name, array_to_string(arg_max(seen, len(seen))[2:], ',') AS ancestors FROM up GROUP BY 1, 2), base AS (SELECT DISTINCT src_collection AS collection, c AS name FROM types WHERE c IS NOT NULL),
inh1 AS (SELECT * FROM cls WHERE edge = 'inherits'), imp AS (SELECT * FROM cls WHERE edge = 'implements'),
ch AS (SELECT collection, parent AS name, {_SET.format('child')} AS children FROM inh1 GROUP BY 1, 2), gc AS (SELECT a.collection, a.parent AS name, {_SET.format('b.child')} AS grandchildren FROM inh1 a JOIN inh1 b ON a.collection = b.collection AND a.child = b.parent GROUP BY 1, 2),
im AS (SELECT collection, child AS name, {_SET.format('parent')} AS implements FROM imp GROUP BY 1, 2), ir AS (SELECT collection, parent AS name, {_SET.format('child')} AS implementers FROM imp GROUP BY 1, 2)
SELECT *, CASE WHEN coalesce(ancestors, children, implements, implementers) IS NULL THEN 'no relations known' END AS note FROM base LEFT JOIN anc USING (collection, name) LEFT JOIN ch USING (collection, name) LEFT JOIN gc USING (collection, name) LEFT JOIN im USING (collection, name) LEFT JOIN ir USING (collection, name)""",
    "relations": f"""WITH {_EDGES}, k AS (SELECT collection, caller_id AS id, 'calls' AS kind, callee_id AS other FROM edges UNION ALL SELECT collection, callee_id, 'called_by', caller_id FROM edges),
u AS (SELECT *, {_U} AS u FROM cur), near AS (SELECT m.collection, m.id, 'same_unit' AS kind, o.id AS other, row_number() OVER (PARTITION BY m.collection, m.id ORDER BY coalesce(o.line_start, 0), o.id) AS place FROM u m JOIN u o ON o.collection = m.collection AND o.u = m.u AND o.id <> m.id WHERE m.kind = 'method')
SELECT *, row_number() OVER (PARTITION BY collection, id, kind ORDER BY other) AS place FROM k UNION ALL SELECT * FROM near WHERE place <= 200""",
    "impact_levels": f"""WITH RECURSIVE {_EDGES}, inh AS{_TREE.split("inh AS", 1)[1]},
hit AS (SELECT collection, id, kind, lower(trim(name)) AS name FROM (SELECT *, {_U} AS u FROM cur) WHERE regexp_matches(lower(regexp_extract(u, '[^/]*$')), '^[abc]')),
l1 AS (SELECT DISTINCT l.src_collection AS collection, l.c AS name FROM link l JOIN hit h ON h.collection = l.src_collection AND h.name = l.p AND h.kind = 'type'), l2 AS (SELECT DISTINCT l.src_collection AS collection, l.c AS name FROM link l JOIN l1 ON l1.collection = l.src_collection AND l1.name = l.p),
ids AS (SELECT collection, lower(trim(name)) AS name, min(id) AS id FROM cur WHERE kind = 'type' GROUP BY 1, 2),
got AS (SELECT e.collection, caller_id AS id, 'caller' AS reason, 1 AS level FROM edges e JOIN hit h ON h.collection = e.collection AND h.id = e.callee_id AND h.kind = 'method'
  UNION ALL SELECT collection, id, 'subtype', level FROM (SELECT collection, name, 1 AS level FROM l1 UNION ALL SELECT collection, name, 2 FROM l2) JOIN ids USING (collection, name))
SELECT collection, id, reason, min(level)::BIGINT AS level FROM got WHERE (collection, id) NOT IN (SELECT collection, id FROM hit) GROUP BY 1, 2, 3""",
    "unit_neighbours": f"""WITH e AS (SELECT src_collection AS collection, lower(trim(child_name)) AS unit, lower(trim(parent_name)) AS target FROM symbol_edges WHERE edge = 'uses' AND trim(child_name) <> '' AND trim(parent_name) <> '' AND lower(trim(child_name)) <> lower(trim(parent_name))),
a AS (SELECT collection, unit AS stem, {_SET.format('target')} AS uses FROM e GROUP BY 1, 2), b AS (SELECT collection, target AS stem, {_SET.format('unit')} AS used_by FROM e GROUP BY 1, 2) SELECT * FROM a FULL JOIN b USING (collection, stem)""",
    "chunk_lookup": f"WITH {CUR}, ids AS (SELECT DISTINCT r.id FROM (SELECT unnest(calls) AS r FROM chunks) WHERE r.id IS NOT NULL) SELECT id, collection, unit, kind, name, line_start::BIGINT AS line_start, md5(code[1:4000]) AS code, length(code) >= 4000 AS truncated FROM cur WHERE id IN (SELECT id FROM ids)",
    "full_search": f"""WITH {CUR}, {_bm25(_BODY, _Q)}, {_bm25(_HEAD, _Q, p="h")},
lists AS (SELECT q_id, 'dense' AS source, id, rank FROM hhits UNION ALL SELECT q_id, 'sparse', id, rank FROM hits), f AS ({_fused("('dense', 1.0), ('sparse', 0.6)")}),
q AS (SELECT q_id, {_IDENT.format("concat_ws(' ', q_text, expand)")} AS qt, {_IDENT.format("q_text")} AS rt FROM (SELECT id AS q_id, coalesce(name, '') AS q_text, lang AS expand FROM cur WHERE id % 100 = 0)),
st AS (SELECT collection, max(priority) AS stars FROM profiles GROUP BY 1),
b AS (SELECT f.q_id, f.id, f.score AS fused, f.dense_rank, f.sparse_rank, c.collection, c.unit, c.kind, c.name, c.line_start, c.code, c.doc, q.rt, stars, CASE WHEN c.id % 5 = 0 THEN 1 + 0.12 * (greatest(1.0, least(10.0, c.id % 12)) - 5.5) / 4.5 ELSE 1.0 END AS mult, {_BOOST.format(q="q.qt", n=_IDENT.format("c.name"))} AS nb
  FROM f JOIN cur c ON c.id = f.id JOIN q ON q.q_id = f.q_id LEFT JOIN st ON st.collection = c.collection),
o AS (SELECT *, fused * nb * CASE WHEN (SELECT count(DISTINCT collection) FROM cur) > 1 THEN 1 + 0.08 * coalesce(stars, 0) ELSE 1.0 END * mult AS score FROM b), r1 AS (SELECT *, row_number() OVER (PARTITION BY q_id {_ORDER.replace("DESC,", "DESC, collection NULLS FIRST,", 1)}) AS rank FROM o),
k AS (SELECT *, lower(trim(regexp_extract(name, '[^.]*$'))) AS bare, kind = 'decl' AND trim(coalesce(doc, '')) <> '' AS documented FROM r1),
w AS (SELECT *, max(CASE WHEN kind = 'method' THEN 1 ELSE 0 END) OVER g AS m, last_value(CASE WHEN documented THEN doc END IGNORE NULLS) OVER (PARTITION BY q_id, collection, unit, bare ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dd FROM k WINDOW g AS (PARTITION BY q_id, collection, unit, bare)),
r2 AS (SELECT * EXCLUDE (rank, doc), CASE WHEN kind = 'method' AND trim(coalesce(doc, '')) = '' THEN coalesce(dd, doc) ELSE doc END AS doc, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS rank FROM w WHERE kind <> 'decl' OR m = 0),
p AS (SELECT *, CASE WHEN rank <= 50 THEN round(1 / (1 + exp(-(4.0 * len(list_intersect(rt, {_IDENT.format("concat_ws(' ', name, doc)")})) / greatest(len(rt), 1) - 2.0))) * nb * mult * 5 / (5 + rank - 1), 9) END AS sc FROM r2),
r3 AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY q_id ORDER BY sc DESC NULLS LAST, rank) AS rank FROM p), u AS (SELECT *, row_number() OVER (PARTITION BY q_id, unit ORDER BY rank) AS u FROM r3),
c AS (SELECT *, coalesce(sum(CASE WHEN u <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY q_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM u),
r4 AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY (u > 3 AND c < 24), rank) AS place, count(*) OVER (PARTITION BY q_id) AS total FROM c)
SELECT q_id, place, id, collection, unit, kind, name, line_start::BIGINT AS line_start, md5(code[1:1800]) AS code, doc, round(score, 6) AS score, total, total > 8 AS has_more, dense_rank, sparse_rank FROM r4 WHERE place <= 8""",
    "near_pairs": """WITH vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT q.id AS a, x.id AS b, round(list_cosine_similarity(q.v, x.v), 6) AS s FROM vec q, vec x WHERE q.id % 100 = 0 AND q.id <> x.id AND round(list_cosine_similarity(q.v, x.v), 6) >= 0.3)
SELECT least(a, b) AS id_a, greatest(a, b) AS id_b, max(s) AS score, coalesce(min(d1.collection) = min(d2.collection), false) AS same_unit FROM l LEFT JOIN documents d1 ON d1.doc_id = least(a, b) LEFT JOIN documents d2 ON d2.doc_id = greatest(a, b) GROUP BY 1, 2""",
    "chapters": rf"""WITH {CUR}, u AS (SELECT collection, {_U} AS unit, count(*) FILTER (kind = 'type') AS types FROM cur WHERE unit IS NOT NULL GROUP BY 1, 2)
SELECT collection, CASE WHEN unit LIKE '%/%' THEN split_part(unit, '/', 1) ELSE 'general' END AS chapter, count(*) AS n_units, sum(types)::BIGINT AS n_types, count(*) FILTER (types = 0) AS n_untyped, string_agg(unit, ',' ORDER BY lower(unit), unit) AS sections FROM u GROUP BY 1, 2""",
    "script_files": f"WITH {CUR} SELECT DISTINCT collection, {_U} AS unit FROM cur WHERE lower({_U}) LIKE '%.js' OR lower({_U}) LIKE '%.py'",
    "zero_results": """SELECT props->>'$.k' AS q, count(*) FILTER (event_type = 'error') AS n_zero, count(*) FILTER (event_type = 'purchase') AS up, count(*) FILTER (event_type = 'error') AS down FROM events GROUP BY 1 ORDER BY n_zero DESC, q NULLS LAST LIMIT 20""",
    "answer_cache": """SELECT user_id, lower(trim(props->>'$.k')) AS key, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2 HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 7 DAYS""",
    "compare_scores": """WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem), g AS (SELECT l_orderkey, l_linenumber + 1 AS i, greatest(1.0, least(10.0, l_quantity)) AS a, greatest(1.0, least(10.0, l_discount * 100)) AS b FROM lineitem)
SELECT l_orderkey, i::BIGINT AS i, l_partkey, round((a + b) / 2, 6) AS combined FROM r JOIN g USING (l_orderkey, i)""",
    "index_run": """WITH o AS (SELECT id, arg_min(struct_pack(kind := kind, h := code_hash), indexed_at) AS r FROM chunks WHERE id % 3 <> 0 GROUP BY 1), n AS (SELECT id, arg_max(struct_pack(kind := kind, h := code_hash), indexed_at) AS r FROM chunks WHERE id % 7 <> 0 GROUP BY 1)
SELECT n.id, CASE WHEN o.r.h IS NOT DISTINCT FROM n.r.h AND o.id IS NOT NULL THEN o.r.kind ELSE n.r.kind END AS kind, n.r.h AS h FROM n LEFT JOIN o ON o.id = n.id""",
    "merged_profiles": f"""WITH {CUR}, o AS (SELECT collection, min(lib) AS lib, min(main_lang) AS ml FROM profiles GROUP BY 1), n AS (SELECT collection, max(lang) AS nl FROM cur GROUP BY 1)
SELECT collection, lib, coalesce(nl, ml) AS main_lang FROM o FULL JOIN n USING (collection)""",
}
ORACLE["block_html"] = f"""WITH b AS ({_BLOCKS}) SELECT doc_id, part, pos, md5(CASE WHEN kind IN ('h1', 'h2', 'h3') THEN '<' || kind || '>' || {_ESC} || '</' || kind || '>' WHEN kind = 'li' THEN '<li>' || {_ESC} || '</li>' WHEN kind = 'code' THEN '<pre>' || {_ESC} || '</pre>' ELSE '<p>' || {_ESC} || '</p>' END) AS html FROM b"""
