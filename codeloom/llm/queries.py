"""Queries of the numbered problems on text and their SQL twins."""

from __future__ import annotations

from codeloom.llm import code_docs, leakage, mixing, provenance, shared_spans, splitting
from codeloom.model import table


def p1_found(spark, d):
    return code_docs.found(table(spark, d, "chunks"))


def p1_pairs(spark, d):
    return code_docs.pairs(table(spark, d, "chunks"))


def p3_found(spark, d):
    return splitting.found(table(spark, d, "chunks"))


def p3_pieces(spark, d):
    return splitting.pieces(table(spark, d, "chunks"))


def p3_rebuilt(spark, d):
    """What the pieces of each item make up again: its size and text, its lines, and whether every piece keeps the limit and the overlap."""
    from pyspark.sql import functions as F

    p = splitting.pieces(table(spark, d, "chunks")).withColumn("core", F.expr("substring(piece, core_start - char_start + 1)"))
    back, core = F.col("core_start") - F.col("char_start"), F.col("char_end") - F.col("core_start")
    fits = (F.char_length("piece") <= splitting.LIMIT) & (F.char_length("piece") == F.col("char_end") - F.col("char_start"))
    laps = back == F.least(F.lit(splitting.OVERLAP), F.col("core_start"), splitting.LIMIT - core)
    # the pieces of one item are no more than the cell they come from
    return p.groupBy("id").agg(
        F.sum(core).alias("n_chars"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "core"))), lambda x: x["core"]), "")).alias("code_md5"),
        F.min("line_start").cast("bigint").alias("line_start"), F.max("line_end").cast("bigint").alias("line_end"), F.min(fits).alias("fits"), F.min(laps).alias("overlaps"), (F.max("piece_no") == F.count(F.lit(1))).alias("numbered"),
    )


def p4_found(spark, d):
    return provenance.found(table(spark, d, "chunks"), table(spark, d, "index_requests"))


def p4_labels(spark, d):
    return provenance.labels(table(spark, d, "chunks"), table(spark, d, "index_requests"))


def p6_found(spark, d):
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_spans(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_cleaned(spark, d):
    return leakage.cleaned(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark, d):
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark, d):
    return shared_spans.found(table(spark, d, "documents"))


def p8_report(spark, d):
    return shared_spans.SharedSpans(table(spark, d, "documents")).report()


def p8_spans(spark, d):
    return shared_spans.SharedSpans(table(spark, d, "documents")).spans()


def p8_removals(spark, d):
    return shared_spans.SharedSpans(table(spark, d, "documents")).removals()


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p3_found, p3_pieces, p3_rebuilt, p4_found, p4_labels, p6_found, p6_spans, p6_cleaned, p7_mix, p7_shares, p8_found, p8_report, p8_spans, p8_removals)}

_CUR = "cur AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) = 1)"
_WORDS = r"list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w))"
# words with their places, the windows of twelve that stand in an item, and the spans that they make up
_LEAKS = rf"""items AS (SELECT item_id, {_WORDS.format("passage")} AS w FROM eval_items),
grams AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM items)),
d AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS w, string_split_regex(text, '[\p{{L}}\p{{N}}]+') AS s FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(s[1:len(w)]) AS sep FROM d),
pos AS (SELECT doc_id, i, lower(word) AS word, length(word) AS n, sum(length(sep) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word) AS a FROM t),
wins AS (SELECT doc_id, i, a, string_agg(word, ' ') OVER x AS g, last_value(a + n) OVER x AS b, count(*) OVER x AS k FROM pos WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
hits AS (SELECT DISTINCT doc_id, item_id, i, a, b FROM wins JOIN grams USING (g) WHERE k = 12),
cut AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) + 12 THEN 0 ELSE 1 END AS new FROM hits), run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS run FROM cut),
leaks AS (SELECT doc_id, item_id, min(a)::BIGINT AS char_start, max(b)::BIGINT AS char_end, (max(i) - min(i) + 12)::BIGINT AS n_words FROM run GROUP BY doc_id, item_id, run)"""
# every window of 400 characters of every text, and what two documents have
_SHARED = """wins AS (SELECT doc_id, i - 1 AS a, md5(text[i:i + 399]) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
twice AS (SELECT h, min(doc_id) AS least FROM wins GROUP BY h HAVING min(doc_id) <> max(doc_id)), shared AS (SELECT doc_id, a, least FROM wins JOIN twice USING (h))"""
_STRETCH = """gaps AS (SELECT *, CASE WHEN a <= lag(a) OVER (PARTITION BY doc_id ORDER BY a) + 400 THEN 0 ELSE 1 END AS new FROM {}), runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
spans AS (SELECT doc_id, min(a)::BIGINT AS char_start, (max(a) + 400)::BIGINT AS char_end, min(least) AS least_doc_id FROM runs GROUP BY doc_id, run)"""
_CLUSTERS = """links AS (SELECT DISTINCT doc_id AS x, least AS y FROM shared WHERE doc_id <> least), both_ AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, x AS r FROM both_ UNION SELECT reach.x, both_.y FROM reach JOIN both_ ON both_.x = reach.r), clusters AS (SELECT x AS doc_id, min(r) AS cluster_id FROM reach GROUP BY x)"""
ORACLE = {
    "p3_found": rf"""WITH {_CUR} SELECT id, CASE WHEN list_max(list_transform(string_split(replace(replace(code, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l: length(l))) > 4000
  THEN 'hard' ELSE 'soft' END AS cut FROM cur WHERE length(code) > 4000""",
    "p3_rebuilt": rf"""WITH {_CUR} SELECT id, length(code)::BIGINT AS n_chars, md5(code) AS code_md5, coalesce(line_start, 1)::BIGINT AS line_start,
  (coalesce(line_start, 1) + len(regexp_extract_all(code, '\r\n|\r|\n')) - CASE WHEN regexp_matches(code, '[\r\n]\z') THEN 1 ELSE 0 END)::BIGINT AS line_end, true AS fits, true AS overlaps, true AS numbered FROM cur WHERE length(code) > 4000""",
    "p6_found": f"""WITH items AS (SELECT item_id, {_WORDS.format("passage")} AS w FROM eval_items),
grams AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM items)),
docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
wins AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM docs))
SELECT DISTINCT doc_id, item_id FROM wins JOIN grams USING (g)""",
    "p6_spans": f"WITH {_LEAKS} SELECT * FROM leaks",
    "p6_cleaned": f"""WITH {_LEAKS}, o AS (SELECT *, max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT doc_id, char_start, char_end FROM leaks)),
m AS (SELECT *, sum(CASE WHEN char_start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY char_start, char_end ROWS UNBOUNDED PRECEDING) AS g FROM o), s AS (SELECT doc_id, g, min(char_start) AS a, max(char_end) AS b FROM m GROUP BY 1, 2),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s), k AS (SELECT doc_id, sum(b - a)::BIGINT AS leaked, string_agg(text[before + 1:a], '' ORDER BY a) || any_value(text)[max(b) + 1:] AS kept, any_value(length(text)) AS n FROM p JOIN documents USING (doc_id) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id)::INT AS n_items FROM leaks GROUP BY 1)
SELECT doc_id, CASE WHEN leaked >= 0.5 * n THEN 'drop' ELSE 'cut' END AS action, n_items, leaked::INT AS leaked_chars, n::INT AS text_chars, CASE WHEN leaked < 0.5 * n THEN kept END AS clean_text FROM k JOIN i USING (doc_id)""",
    "p8_found": f"WITH {_SHARED} SELECT DISTINCT doc_id FROM shared",
    "p8_spans": f"WITH {_SHARED}, {_STRETCH.format('shared')} SELECT doc_id, char_start, char_end, least_doc_id FROM spans",
    "p8_report": f"""WITH RECURSIVE {_SHARED}, {_STRETCH.format('shared')}, {_CLUSTERS}, per AS (SELECT doc_id, count(*) AS n_spans, sum(char_end - char_start) AS shared_chars FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(length(text), 0)::INT AS n_chars, coalesce(n_spans, 0)::INT AS n_spans, coalesce(shared_chars, 0)::BIGINT AS shared_chars, cluster_id FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN clusters USING (doc_id)""",
    "p8_removals": f"""WITH RECURSIVE {_SHARED}, extra AS (SELECT * FROM shared WHERE doc_id <> least), {_STRETCH.format('extra')}, {_CLUSTERS} SELECT doc_id, char_start, char_end, cluster_id FROM spans JOIN clusters USING (doc_id)""",
}
