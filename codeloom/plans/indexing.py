"""Lifecycle queries: diffs, merges, versions, changes, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.model import file_path, table
from codeloom.operators import graph as G
from codeloom.operators import lifecycle as L
from codeloom.plans.common import CUR, cur, wide
from codeloom.streaming import changes as C


def _states(spark, d):
    """Old: each id's newest row of the first half of the indexing time. New: each id's newest row, but for what hasn't been indexed since the first tenth."""
    c = table(spark, d, "chunks").select("id", "indexed_at", F.col("code_hash").alias("h"))
    span = c.agg(F.min("indexed_at").alias("t0"), F.max("indexed_at").alias("t1"))  # one row
    at = lambda share: F.timestamp_seconds(F.unix_seconds("t0") + F.floor((F.unix_seconds("t1") - F.unix_seconds("t0")) * share))
    c = c.withColumn("indexed_at", F.col("indexed_at").cast("timestamp")).join(F.broadcast(span.select(F.col("t0").cast("timestamp").alias("t0"), F.col("t1").cast("timestamp").alias("t1"))))
    newest = F.max_by("h", "indexed_at").alias("h")
    old = c.where(F.col("indexed_at") <= at(0.5)).groupBy("id").agg(newest)
    new = c.groupBy("id").agg(newest, F.max("indexed_at").alias("last"), F.max(at(0.1)).alias("keep")).where("last > keep").select("id", "h")
    return old, new


def index_diff(spark, d):
    return L.diff(*_states(spark, d), ["id"], "h")


def diff_counts(spark, d):
    return L.diff(*_states(spark, d), ["id"], "h").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def embedding_needs(spark, d):
    had = table(spark, d, "chunks").where("kind = 'method'").select("id")
    return L.embedding_needs(L.diff(*_states(spark, d), ["id"], "h"), had, ["id"]).groupBy("status", "needs").agg(F.count(F.lit(1)).alias("n"))


def vector_state(spark, d):
    docs = table(spark, d, "documents").withColumn("source", F.lower(F.trim("source")))
    return L.vector_state(docs, table(spark, d, "embeddings"), "source", "doc_id", "vec_id")


def _sources(spark, d):
    docs = table(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id", F.when(F.col("lang") == "en", 1).when(F.col("lang") == "tr", 2).otherwise(3).alias("src_ord"))
    return docs.where("key is not null").groupBy("key", "src_ord").agg(F.min("doc_id").alias("doc_id"))


def merge_first_wins(spark, d):
    return wide(L.merge_first_wins(_sources(spark, d), ["key"], "src_ord"))


def merge_collisions(spark, d):
    return wide(L.merge_collisions(_sources(spark, d), ["key"], "src_ord"))


def latest_per_key(spark, d):
    """Each collection's latest request, and how many of its chunks were last indexed before it."""
    r = table(spark, d, "index_requests")
    m = F.max(F.struct("requested_at", "request_id")).alias("m")
    last = r.where("collection is not null").groupBy("collection").agg(m, F.count_distinct("request_id").alias("n_requests"))
    c = cur(spark, d, ["collection", "indexed_at"]).join(last.select("collection", "m.requested_at"), "collection")
    behind = c.where("indexed_at < requested_at").groupBy("collection").agg(F.count(F.lit(1)).alias("n_behind"))
    out = last.join(behind, "collection", "left").fillna(0, ["n_behind"])
    return out.select("collection", "m.request_id", F.date_format("m.requested_at", "yyyy-MM-dd HH:mm:ss").alias("requested"), "n_requests", "n_behind")


def retain_newest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return wide(L.keep_newest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "place"))


def upsert_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderstatus = 'O'").withColumn("o_orderstatus", F.lit("X"))
    return L.upsert(o.where("o_orderstatus <> 'P'"), new, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def exact_duplicates(spark, d):
    """One row per document that has copies: its class is the least id of its text."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("h"))
    g = docs.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return docs.join(g, "h").select("doc_id", "class_id", "copies")


def duplicate_code(spark, d):
    """Classes of equal method bodies of 300 characters or more, with how many units they span."""
    return _code_classes(spark, d)[1].select("class_id", "copies", "units")


def duplicate_code_members(spark, d):
    """One row per chunk of such a class."""
    c, g = _code_classes(spark, d)
    return c.join(g, "h").select("id", "class_id", "copies", "units")


def _code_classes(spark, d):
    """Methods (id, unit, h) and the classes of those that share h."""
    c = cur(spark, d, ["unit", "kind", "code"]).where("kind = 'method' and char_length(code) >= 300").select("id", file_path(F.col("unit")).alias("unit"), F.md5(F.regexp_replace("code", r"[ \t\r\n]+", "")).alias("h"))
    g = c.groupBy("h").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.count_distinct("unit").alias("units")).where("copies > 1")
    return c, g


def _changes(spark, d):
    op = F.when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "click", "move").otherwise("upsert")
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("p/"), F.col("user_id")).alias("path"), F.concat(F.lit("p/"), F.col("user_id") + 1).alias("new_path"))


def cdc_fold(spark, d):
    return C.fold_changes(_changes(spark, d))


def rate_limit(spark, d):
    return C.limit_rate(table(spark, d, "events"), "user_id", "ts", "event_id", limit=2, window_s=86_400.0)


def hourly_windows(spark, d):
    return C.windows(table(spark, d, "events"), "ts", ["event_type"], "value").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def extract_calls(spark, d):
    c = cur(spark, d, ["kind", "name", "code"]).where("kind = 'method'")
    return c.select("id", F.array_join(G.called_names(F.col("code"), T.bare_name(F.col("name"))), ",").alias("calls"))


def extract_imports(spark, d):
    """Imports of the heads of all languages, read from their text; the twin takes the list that the table has."""
    from codeloom.sources.chunker import imports

    c = cur(spark, d, ["kind", "lang", "code"]).where("kind = 'unithead'")
    return c.select("id", F.array_join(imports(F.col("code"), F.col("lang")), ",").alias("imports"))


def huge_chunks(spark, d):
    c = cur(spark, d, ["kind", "code"])
    lines = F.regexp_count("code", F.lit("\n"))
    return c.where(lines > 400).select("id", "kind", lines.cast("bigint").alias("lines"), F.ceil((lines + 1) / 400).alias("n_parts"))


def safe_paths(spark, d):
    u = table(spark, d, "chunks").select("collection", "unit").distinct()
    return u.select("collection", "unit", T.safe_path(F.col("collection"), F.col("unit")).alias("safe"), T.safe_path(F.col("collection"), F.concat(F.lit("../"), F.col("unit"))).alias("escaped"))


def language_census(spark, d):
    from codeloom.operators.analytics import census

    f = cur(spark, d, ["collection", "unit", "lang"]).select("collection", file_path(F.col("unit")).alias("unit"), F.coalesce("lang", F.lit("pascal")).alias("lang")).distinct()
    return wide(census(f, ["collection"], F.col("lang")))


def export_rows(spark, d):
    return L.export_rows(cur(spark, d, ["kind", "line_start", "code_hash"]))


def export_orders(spark, d):
    return L.export_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


def rechunk_units(spark, d):
    """Files put together from their chunks, and cut into chunks again."""
    from codeloom.operators.documents import read_unit
    from codeloom.sources.chunker import chunk_files

    c = cur(spark, d).withColumn("unit", file_path(F.col("unit")))
    lang = c.groupBy("collection", "unit").agg(F.min(F.coalesce("lang", F.lit("pascal"))).alias("lang"))
    files = read_unit(c, cap=None).join(lang, ["collection", "unit"]).select(F.concat_ws("/", "collection", "unit").alias("unit"), "lang", "content")
    return chunk_files(files, "again").drop("code", "extends_list", "uses_list")


QUERIES = {f.__name__: f for f in (index_diff, diff_counts, embedding_needs, vector_state, merge_first_wins, merge_collisions, latest_per_key, retain_newest, upsert_rows, exact_duplicates, duplicate_code, duplicate_code_members, cdc_fold, rate_limit, hourly_windows, extract_calls, extract_imports, huge_chunks, safe_paths, language_census, export_rows, export_orders, rechunk_units)}

_STATES = """t AS (SELECT epoch_us(min(indexed_at)) // 1000000 AS t0, epoch_us(max(indexed_at)) // 1000000 AS t1 FROM chunks),
r AS (SELECT id, code_hash AS h, indexed_at AS i, epoch_us(indexed_at) AS us, (t0 + floor((t1 - t0) * 0.5)) * 1000000 AS half, (t0 + floor((t1 - t0) * 0.1)) * 1000000 AS tenth FROM chunks, t),
o AS (SELECT id, arg_max(h, i) AS oh FROM r WHERE us <= half GROUP BY id), n AS (SELECT id, arg_max(h, i) AS nh FROM r GROUP BY id HAVING max(us) > max(tenth)),
s AS (SELECT id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'deleted' WHEN oh = nh THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n USING (id))"""
_SRC = "src AS (SELECT md5(text) AS key, CASE lang WHEN 'en' THEN 1 WHEN 'tr' THEN 2 ELSE 3 END::BIGINT AS src_ord, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1, 2)"
_KEYS = ", ".join(f"'{x}'" for x in G.KEYWORDS)
_CALLS = rf"list_filter(regexp_extract_all(lower(coalesce(code, '')), '\b([a-z_]\w*)\s*\(', 1), lambda x: x NOT IN ({_KEYS}) AND x <> coalesce(lower(trim(regexp_extract(name, '[^.]*$'))), ''))"
# list_distinct keeps no order: the first place of each name does
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"

ORACLE = {
    "index_diff": f"WITH {_STATES} SELECT id, status FROM s",
    "diff_counts": f"WITH {_STATES} SELECT status, count(*) AS n FROM s GROUP BY status",
    "embedding_needs": f"""WITH {_STATES}, had AS (SELECT DISTINCT id FROM chunks WHERE kind = 'method'),
x AS (SELECT s.id, status, had.id IS NOT NULL AS had FROM s LEFT JOIN had USING (id))
SELECT status, CASE status WHEN 'new' THEN true WHEN 'changed' THEN true WHEN 'unchanged' THEN NOT had ELSE false END AS needs, count(*) AS n FROM x GROUP BY ALL""",
    "vector_state": """WITH v AS (SELECT DISTINCT vec_id FROM embeddings), g AS (SELECT lower(trim(source)) AS source, count(*) AS n_docs, count(vec_id) AS n_vectors FROM documents LEFT JOIN v ON vec_id = doc_id GROUP BY 1)
SELECT *, CASE WHEN n_vectors = 0 THEN 'none' WHEN n_vectors < n_docs THEN 'partial' ELSE 'full' END AS state FROM g""",
    "merge_first_wins": f"WITH {_SRC} SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY key ORDER BY src_ord) = 1",
    "merge_collisions": f"WITH {_SRC}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src_ord) AS n FROM src) SELECT src_ord, count(*) AS n_rows, count(*) FILTER (n > 1) AS n_collisions FROM n GROUP BY 1",
    "latest_per_key": f"""WITH {CUR}, r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY requested_at DESC, request_id DESC) AS k FROM index_requests WHERE collection IS NOT NULL), n AS (SELECT collection, count(DISTINCT request_id) AS n_requests FROM index_requests GROUP BY 1),
b AS (SELECT r.collection, count(*) AS n_behind FROM r JOIN cur ON cur.collection = r.collection AND cur.indexed_at < r.requested_at WHERE k = 1 GROUP BY 1)
SELECT collection, request_id, strftime(requested_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS requested, n_requests, coalesce(n_behind, 0) AS n_behind FROM r JOIN n USING (collection) LEFT JOIN b USING (collection) WHERE k = 1""",
    "retain_newest": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 3",
    "upsert_rows": """SELECT CASE WHEN o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
    "exact_duplicates": "WITH g AS (SELECT md5(text) AS h, min(doc_id) AS class_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, class_id, copies FROM documents JOIN g ON md5(text) = h",
    "duplicate_code": rf"""WITH {CUR}, c AS (SELECT id, regexp_replace(replace(trim(unit), '\', '/'), '^(?:\./+)+', '') AS unit, md5(regexp_replace(code, '[ \t\r\n]+', '', 'g')) AS h FROM cur WHERE kind = 'method' AND length(code) >= 300)
SELECT min(id) AS class_id, count(*) AS copies, count(DISTINCT unit) AS units FROM c GROUP BY h HAVING count(*) > 1""",
    "duplicate_code_members": rf"""WITH {CUR}, c AS (SELECT id, regexp_replace(replace(trim(unit), '\', '/'), '^(?:\./+)+', '') AS unit, md5(regexp_replace(code, '[ \t\r\n]+', '', 'g')) AS h FROM cur WHERE kind = 'method' AND length(code) >= 300),
g AS (SELECT h, min(id) AS class_id, count(*) AS copies, count(DISTINCT unit) AS units FROM c GROUP BY h HAVING count(*) > 1) SELECT id, class_id, copies, units FROM c JOIN g USING (h)""",
    "cdc_fold": """WITH e AS (SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 'delete' WHEN 'click' THEN 'move' ELSE 'upsert' END AS op, user_id FROM events),
s AS (SELECT seq, 0 AS i, 'p/' || user_id AS path, CASE WHEN op = 'move' THEN 'delete' ELSE op END AS op FROM e UNION ALL SELECT seq, 1, 'p/' || (user_id + 1), 'upsert' FROM e WHERE op = 'move')
SELECT path, op, seq FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC, i DESC) = 1""",
    "hourly_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "extract_calls": f"WITH {CUR}, c AS (SELECT id, {_CALLS} AS l FROM cur WHERE kind = 'method') SELECT id, array_to_string({_FIRST.format('l')}, ',') AS calls FROM c",
    "extract_imports": f"WITH {CUR} SELECT id, coalesce(array_to_string(uses_list, ','), '') AS imports FROM cur WHERE kind = 'unithead'",
    "huge_chunks": f"WITH {CUR}, c AS (SELECT id, kind, (length(code) - length(replace(code, chr(10), '')))::BIGINT AS lines FROM cur) SELECT *, ceil((lines + 1) / 400)::BIGINT AS n_parts FROM c WHERE lines > 400",
    "safe_paths": r"""WITH u AS (SELECT DISTINCT collection, unit, replace(unit, '\', '/') AS p FROM chunks)
SELECT collection, unit, coalesce(regexp_full_match(collection, '[A-Za-z0-9_.\-]{1,64}') AND collection NOT IN ('.', '..') AND p <> '' AND p NOT LIKE '%:%' AND p NOT LIKE '/%' AND NOT list_contains(string_split(p, '/'), '..'), false) AS safe, false AS escaped FROM u""",
    "language_census": rf"""WITH {CUR}, f AS (SELECT DISTINCT collection, regexp_replace(replace(trim(unit), '\', '/'), '^(?:\./+)+', '') AS unit, coalesce(lang, 'pascal') AS label FROM cur), g AS (SELECT collection, label, count(*) AS n FROM f GROUP BY ALL)
SELECT collection, label, n, floor(100.0 * n / sum(n) OVER (PARTITION BY collection) + 0.5)::BIGINT AS percent, row_number() OVER (PARTITION BY collection ORDER BY n DESC, label) AS place FROM g QUALIFY place <= 2""",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT user_id, event_id, k, true AS accepted, NULL::TIMESTAMPTZ AS older, ts::TIMESTAMPTZ AS newer FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, ok, CASE WHEN ok THEN newer ELSE older END, CASE WHEN ok THEN e.ts::TIMESTAMPTZ ELSE newer END
  FROM (SELECT w.*, n.event_id AS e2, n.k AS k2, n.ts AS t2, older IS NULL OR n.ts::TIMESTAMPTZ - older > INTERVAL 24 HOURS AS ok FROM w JOIN e n ON n.user_id = w.user_id AND n.k = w.k + 1) x JOIN e ON e.user_id = x.user_id AND e.k = x.k2)
SELECT user_id, event_id, accepted FROM w""",
    "export_orders": """SELECT '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' AS value FROM orders""",
    "export_rows": f"""WITH {CUR} SELECT '{{"id":' || id || coalesce(',"kind":"' || kind || '"', ',"kind":null') || coalesce(',"line_start":' || line_start, ',"line_start":null') || coalesce(',"code_hash":"' || code_hash || '"', ',"code_hash":null') || '}}' AS value FROM cur""",
}
