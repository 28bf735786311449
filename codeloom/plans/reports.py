"""Analytics, quality metrics, texts and the relational star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.model import table
from codeloom.operators import analytics as A
from codeloom.operators import documents as D
from codeloom.operators import search as S
from codeloom.plans.common import CUR, cur, wide
from codeloom.plans.retrieval import _bm25, _BODY


def _log(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("ms"), (F.col("event_type") == "error").alias("zero"), F.col("ts").alias("at"), "user_id", F.get_json_object("props", "$.k").alias("q"))


def search_analytics(spark, d):
    return A.usage(_log(spark, d))


def top_queries(spark, d):
    return A.top_counts(_log(spark, d), "q")


def latency(spark, d):
    r = A.latency(_log(spark, d), "mode", "ms")
    return r.select("mode", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def retrieval_metrics(spark, d):
    """Every evaluation question against all current chunks by BM25; a hit is a name that contains an expected one."""
    e = table(spark, d, "eval_items")
    c = cur(spark, d, ["name", "doc", "code"])
    q = e.select(F.col("item_id").alias("q_id"), F.col("question").alias("q_text"))
    hits = S.bm25(c.select("id", F.concat_ws(" ", "name", "doc", "code").alias("body")), q, top=8, doc_id="id", text="body")
    res = hits.withColumnRenamed("doc_id", "id").join(c.select("id", F.col("name").alias("hit_name")), "id")
    return A.retrieval_metrics(res, e.select(F.col("item_id").alias("q_id"), "collection", F.col("expected_names").alias("expected")))


def missing_collections(spark, d):
    """Collections that evaluation items or requests name and no chunk belongs to."""
    named = table(spark, d, "eval_items").select("collection").union(table(spark, d, "index_requests").select("collection")).distinct()
    return named.join(table(spark, d, "chunks").select("collection").distinct(), "collection", "left_anti")


def collection_summary(spark, d):
    """Collections with their profile, latest request and counts."""
    c = cur(spark, d, ["collection", "unit", "kind"]).groupBy("collection").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("kind") == "method").alias("n_methods"))
    p = table(spark, d, "profiles").groupBy("collection").agg(F.max("priority").cast("bigint").alias("priority"), F.min(F.coalesce("main_lang", F.lit("pascal"))).alias("main_lang"))
    r = table(spark, d, "index_requests").groupBy("collection").agg(F.max(F.struct("requested_at", "request_id")).alias("m")).select("collection", F.col("m.request_id").alias("last_request"))
    return c.join(p, "collection", "left").join(r, "collection", "left")


def owners(spark, d):
    """Owners in any spelling, with their collections and the current chunks in them."""
    key = F.lower(F.regexp_replace(F.trim("owner_name"), r"\s+", " "))
    p = table(spark, d, "profiles").select(key.alias("owner"), "collection", "owner_name")
    n = cur(spark, d, ["collection"]).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    chunks = p.select("owner", "collection").distinct().join(n, "collection").groupBy("owner").agg(F.sum("n").alias("n_chunks"))
    own = p.groupBy("owner").agg(F.count_distinct("collection").alias("n_collections"), F.count_distinct("owner_name").alias("n_spellings"))
    return own.alias("o").join(chunks.alias("c"), F.expr("o.owner <=> c.owner"), "left").select("o.owner", "n_collections", "n_spellings", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def user_sessions(spark, d):
    s = A.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return s.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), F.date_format("session_end", "yyyy-MM-dd HH:mm:ss").alias("session_end"), "n_events")


def chat_history(spark, d):
    e = table(spark, d, "events").withColumn("text", F.concat_ws(" ", "event_type", "props"))
    return wide(D.chat_history(e, "user_id", [F.desc("ts"), F.desc("event_id")], "text"))


def markdown_blocks(spark, d):
    return wide(D.markdown_blocks(table(spark, d, "documents")))


def translation_overlay(spark, d):
    """Every English document, with the German one of the same collection, source (in any spelling) and place among them, where there is one; without collection or source there is none."""
    from codeloom.operators.skew import ranked

    source = F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "collection", source.alias("source"), F.lower(F.trim("lang")).alias("lang"), "text")
    docs = docs.select("doc_id", "collection", "source", "lang", F.md5("text").alias("body")).where("lang in ('en', 'de')")
    r = ranked(docs, ["collection", "source", "lang"], ["doc_id"])
    base, key = r.where("lang = 'en'").drop("lang"), ["collection", "source", "place"]
    return D.overlay(base, r.select(*key, "lang", "body"), key, "body", "de").select("doc_id", "translated", "body")


def prompt_windows(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return wide(docs.select("doc_id", T.context_window(F.char_length("text") * 20, F.lit(600)).alias("num_ctx"), T.html_escape(F.col("text")).alias("escaped")))


def text_sizes(spark, d):
    """Documents by normalised language, with rollup."""
    lang = F.coalesce(F.nullif(F.lower(F.regexp_extract(F.trim("lang"), r"^([A-Za-z]{2})(?:-.*)?$", 1)), F.lit("")), F.lit("und"))
    return table(spark, d, "documents").withColumn("lang2", lang).rollup("lang2").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).cast("bigint").alias("chars"), F.count_if(F.coalesce(F.char_length("text"), F.lit(-1)) != F.coalesce("n_chars", F.lit(-1))).alias("n_wrong"))


def pricing_summary(spark, d):
    l = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(disc), 2).alias("sum_disc_price"), F.round(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def region_volume(spark, d):
    """Sales by region of customers and suppliers; the dimensions have fixed or checked sizes, so the optimizer decides on broadcasts."""
    t = lambda n: table(spark, d, n)
    nr = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = t("customer").join(nr, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("customer_region"))
    s = t("supplier").join(nr, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("supplier_region"))
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("customer_region", "supplier_region").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def brand_rollup(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.rollup("p_brand", "l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count(F.lit(1)).alias("n"))


def top_customers(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    j = o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return wide(j.withColumn("place", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("total"), "o_custkey"))).where("place <= 10").select("c_mktsegment", "o_custkey", "total", "n", "place"))


def idle_customers(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority like '1-%'")
    c = table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("avg_balance"))


QUERIES = {f.__name__: f for f in (search_analytics, top_queries, latency, retrieval_metrics, missing_collections, collection_summary, owners, user_sessions, chat_history, markdown_blocks, translation_overlay, prompt_windows, text_sizes, pricing_summary, region_volume, brand_rollup, top_customers, idle_customers)}

_LOG = '''log AS (SELECT event_type AS mode, value AS ms, event_type = 'error' AS zero, ts AS "at", user_id, props->>'$.k' AS q FROM events)'''
ORACLE = {
    "search_analytics": f"""WITH {_LOG}, m AS (SELECT max("at") AS newest FROM log) SELECT mode, count(*) AS n, count(*) FILTER (WHERE zero) AS n_zero, round(avg(ms), 6) AS avg_ms, count(*) FILTER (WHERE log."at" > newest - INTERVAL 24 HOURS) AS n_recent FROM log, m GROUP BY ROLLUP (mode)""",
    "top_queries": f"WITH {_LOG} SELECT q, count(*) AS n FROM log GROUP BY q ORDER BY n DESC, q NULLS LAST LIMIT 20",
    "latency": f"""WITH {_LOG}, r AS (SELECT mode, ms, row_number() OVER (PARTITION BY mode ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY mode) AS n FROM log WHERE ms IS NOT NULL)
SELECT mode, round(quantile_cont(ms, 0.5), 6) AS p50, round(max(CASE WHEN i = greatest(0, floor(n * 95 / 100) - 1) THEN ms END), 6) AS p95 FROM r GROUP BY mode""",
    "retrieval_metrics": f"""WITH {CUR}, {_bm25(_BODY, "SELECT item_id AS q_id, question AS q_text FROM eval_items", 8)},
g AS (SELECT item_id AS q_id, collection, expected_names FROM eval_items),
f AS (SELECT q_id, min(rank) AS r FROM hits JOIN cur USING (id) JOIN g USING (q_id) WHERE len(list_filter(expected_names, lambda x: length(x) > 0 AND contains(lower(cur.name), lower(x)))) > 0 GROUP BY q_id)
SELECT collection, count(*) AS questions, round(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr, round(avg(coalesce(1.0 / log2(1 + r), 0.0)), 6) AS ndcg
FROM (SELECT g.q_id, g.collection, r FROM g LEFT JOIN f USING (q_id)) GROUP BY ROLLUP (collection)""",
    "missing_collections": "SELECT DISTINCT collection FROM (SELECT collection FROM eval_items UNION ALL SELECT collection FROM index_requests) WHERE collection IS NULL OR collection NOT IN (SELECT collection FROM chunks WHERE collection IS NOT NULL)",
    "collection_summary": f"""WITH {CUR}, c AS (SELECT collection, count(*) AS n_chunks, count(*) FILTER (kind = 'method') AS n_methods FROM cur GROUP BY 1), p AS (SELECT collection, max(priority)::BIGINT AS priority, min(coalesce(main_lang, 'pascal')) AS main_lang FROM profiles GROUP BY 1),
r AS (SELECT collection, arg_max(request_id, (requested_at, request_id)) AS last_request FROM index_requests GROUP BY 1) SELECT * FROM c LEFT JOIN p USING (collection) LEFT JOIN r USING (collection)""",
    "owners": rf"""WITH {CUR}, p AS (SELECT lower(regexp_replace(trim(owner_name), '\s+', ' ', 'g')) AS owner, collection, owner_name FROM profiles), n AS (SELECT collection, count(*) AS n FROM cur GROUP BY 1),
c AS (SELECT owner, sum(n)::BIGINT AS n_chunks FROM (SELECT DISTINCT owner, collection FROM p) JOIN n USING (collection) GROUP BY 1), o AS (SELECT owner, count(DISTINCT collection) AS n_collections, count(DISTINCT owner_name) AS n_spellings FROM p GROUP BY 1)
SELECT o.owner, n_collections, n_spellings, coalesce(n_chunks, 0) AS n_chunks FROM o LEFT JOIN c ON o.owner IS NOT DISTINCT FROM c.owner""",
    "user_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n_events FROM s GROUP BY user_id, s""",
    "chat_history": """WITH b AS (SELECT user_id, concat_ws(' ', event_type, props) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) SELECT user_id, 5 - back AS turn, t[1:400] AS turn_text FROM b WHERE back <= 4""",
    "markdown_blocks": r"""WITH p AS (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '(?m)^[ \t]*```[^\n]*$') AS parts FROM documents),
s AS (SELECT doc_id, unnest(parts) AS body, generate_subscripts(parts, 1) - 1 AS part FROM p), l AS (SELECT doc_id, part, string_split(body, chr(10)) AS ls FROM s), x AS (SELECT doc_id, part, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l)
SELECT doc_id, part, pos, CASE WHEN part % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^### ') THEN 'h3' WHEN regexp_matches(line, '^## ') THEN 'h2' WHEN regexp_matches(line, '^# ') THEN 'h1' WHEN regexp_matches(line, '^[ \t]*[-*] ') THEN 'li' ELSE 'p' END AS kind,
CASE WHEN part % 2 = 1 THEN line ELSE trim(regexp_replace(line, '^(#{1,3} |[ \t]*[-*] )', '')) END AS content FROM x WHERE trim(line) <> ''""",
    "translation_overlay": r"""WITH r AS (SELECT doc_id, collection, regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') AS source, lower(trim(lang)) AS lang, md5(text) AS body FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY collection, source, lang ORDER BY doc_id) AS place FROM r WHERE lang IN ('en', 'de'))
SELECT e.doc_id, g.body IS NOT NULL AS translated, coalesce(g.body, e.body) AS body FROM p e LEFT JOIN p g ON g.collection = e.collection AND g.source = e.source AND g.place = e.place AND g.lang = 'de' WHERE e.lang = 'en'""",
    "prompt_windows": """SELECT doc_id, greatest(4096, least(16384, floor(length(text) * 20 / 3.5) + 600 + 256))::BIGINT AS num_ctx, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM documents WHERE text IS NOT NULL""",
    "text_sizes": """WITH d AS (SELECT coalesce(nullif(lower(regexp_extract(trim(lang), '^([A-Za-z]{2})(?:-.*)?$', 1)), ''), 'und') AS lang2, length(text) AS n, n_chars FROM documents)
SELECT lang2, count(*) AS n, coalesce(sum(n), 0)::BIGINT AS chars, count(*) FILTER (coalesce(n, -1) <> coalesce(n_chars, -1)) AS n_wrong FROM d GROUP BY ROLLUP (lang2)""",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "region_volume": """SELECT rc.r_name AS customer_region, rs.r_name AS supplier_region, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN region rc ON nc.n_regionkey = rc.r_regionkey JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN region rs ON ns.n_regionkey = rs.r_regionkey GROUP BY 1, 2""",
    "brand_rollup": "SELECT p_brand, l_returnflag, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_brand, l_returnflag)",
    "top_customers": "WITH o AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1) SELECT c_mktsegment, o_custkey, total, n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY total DESC, o_custkey) AS place FROM o JOIN customer ON o_custkey = c_custkey QUALIFY place <= 10",
    "idle_customers": "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS avg_balance FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1-%') GROUP BY 1",
}
