"""Graph queries: calls, types, units, impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.model import file_path, table
from codeloom.operators import components, documents
from codeloom.operators import graph as G
from codeloom.operators import hierarchy as H
from codeloom.plans.common import CUR, cur, wide
from codeloom.plans.indexing import _CALLS, _FIRST
from codeloom.plans.training import _TREE


def call_edges(spark, d):
    return G.call_edges(cur(spark, d))


def called_by(spark, d):
    return wide(G.called_by(G.call_edges(cur(spark, d)), cap=None).withColumn("callers", F.array_join("callers", ",")))


def symbol_edges(spark, d):
    return G.symbol_edges(cur(spark, d))


def _links(spark, d):
    """Latest inherits link per type, as child and parent."""
    return H.type_links(table(spark, d, "symbol_edges"))


def type_relatives(spark, d):
    """Per type: ancestors up to 12 steps, and descendants one and two steps below."""
    h = H.type_hierarchy(table(spark, d, "chunks"), table(spark, d, "symbol_edges"))
    up = h.select("src_collection", "node_name", F.least(F.greatest("tree_depth", F.lit(0)), F.lit(12)).alias("n_ancestors"))
    links = _links(spark, d)
    one = links.groupBy("src_collection", F.col("parent").alias("node_name")).agg(F.count(F.lit(1)).alias("n_children"))
    two = links.alias("a").join(links.alias("b"), (F.col("a.src_collection") == F.col("b.src_collection")) & (F.col("a.child") == F.col("b.parent")))
    two = two.groupBy(F.col("a.src_collection").alias("src_collection"), F.col("a.parent").alias("node_name")).agg(F.count(F.lit(1)).alias("n_grandchildren"))
    return up.join(one, ["src_collection", "node_name"], "left").join(two, ["src_collection", "node_name"], "left").fillna(0, ["n_children", "n_grandchildren"])


def type_families(spark, d):
    """Types of a collection that inheritance connects, by connected components; the family is the least name."""
    key = lambda c: F.concat("src_collection", F.lit("|"), F.col(c))
    return components.connected_components(_links(spark, d).select(key("child").alias("a"), key("parent").alias("b")))


def class_tree(spark, d):
    """Flattened: type, parent, whether the parent is outside the collection's types, place among its siblings."""
    from pyspark.sql import Window

    links = _links(spark, d)
    types = H.collection_types(table(spark, d, "chunks"), table(spark, d, "symbol_edges"))
    t = types.join(links, ["src_collection", "child"], "left").join(types.select("src_collection", F.col("child").alias("parent"), F.lit(True).alias("known")), ["src_collection", "parent"], "left")
    w = Window.partitionBy("src_collection", "parent").orderBy("child")
    return wide(t.select("src_collection", "child", "parent", (F.col("parent").isNotNull() & F.col("known").isNull()).alias("external"), F.row_number().over(w).alias("place")))


def _deps(spark, d):
    c = cur(spark, d, ["collection", "unit", "kind", "uses_list"]).withColumn("unit", file_path(F.col("unit")))
    return G.resolve_units(G.unit_uses(c), c.select("collection", "unit").distinct())


def unit_deps(spark, d):
    return _deps(spark, d)


def unit_dependency_counts(spark, d):
    return G.unit_dependencies(_stem_deps(spark, d))


def _stem_deps(spark, d):
    """Uses edges between the units of the symbol graph, by stem."""
    e = table(spark, d, "symbol_edges").where("edge = 'uses'").select(F.col("src_collection").alias("collection"), F.lower(F.trim("child_name")).alias("unit"), F.lower(F.trim("parent_name")).alias("target"))
    return e.where("unit <> '' and target <> ''").distinct()


def topo_order(spark, d):
    return wide(G.topological_layers(_stem_deps(spark, d)))


def impact(spark, d):
    """What a change of the units whose stem begins with A to C reaches."""
    c = cur(spark, d).withColumn("unit", file_path(F.col("unit")))
    changed = c.where(F.lower(T.stem(F.col("unit"))).rlike("^[abc]")).select("collection", "unit").distinct()
    links = _links(spark, d).withColumnRenamed("src_collection", "collection")
    ids = c.where("kind = 'type'").groupBy("collection", F.lower(F.trim("name")).alias("child")).agg(F.min("id").alias("child_id"))
    return G.impact(changed, c, G.call_edges(c), links.join(ids, ["collection", "child"]))


def references(spark, d):
    names = table(spark, d, "eval_items").select("collection", F.explode("expected_names").alias("name"))
    c = cur(spark, d)
    return G.references(c, G.call_edges(c), names.select("collection", T.bare_name(F.col("name")).alias("name")))


def read_unit(spark, d):
    """Whole units, as the digest of their text."""
    c = cur(spark, d).withColumn("unit", file_path(F.col("unit")))
    return wide(documents.read_unit(c, cap=None).withColumn("content", F.md5("content")))


def context_pack(spark, d):
    """Per method with callers: itself, its first 12 callers and callees, under a budget of 2,000 characters: the pack's feature. The edges are whole."""
    c = cur(spark, d).select("collection", "id", "kind", "name", "unit", F.char_length("code").alias("n_chars"))
    e = G.call_edges(cur(spark, d))
    info = c.select("collection", "id", F.concat_ws("|", "name", F.col("id").cast("string")).alias("title"), "n_chars")
    own = e.select("collection", F.col("callee_id").alias("root")).distinct()
    part = lambda df, o: df.join(info, ["collection", "id"]).select("collection", "root", F.lit(o).alias("o"), "id", "title", "n_chars")
    callers = e.select("collection", F.col("callee_id").alias("root"), F.col("caller_id").alias("id"))
    callees = e.select("collection", F.col("caller_id").alias("root"), F.col("callee_id").alias("id")).join(own, ["collection", "root"], "left_semi")
    s = part(own.withColumn("id", F.col("root")), 0).union(_first(part(callers, 1), 12)).union(_first(part(callees, 2), 12))
    s = s.withColumn("ord", F.col("o") * F.lit(1 << 48) + F.col("id"))
    p = documents.pack(s, 2_000, ["collection", "root"])
    return wide(p.select("collection", "root", "used_chars", "used_tokens", F.array_join("kept", ",").alias("kept"), F.array_join("omitted", ",").alias("omitted")))


def _first(df, n):
    from codeloom.operators.search import top_k

    return top_k(df, ["collection", "root"], [F.asc("id")], n).drop("rank")


QUERIES = {f.__name__: f for f in (call_edges, called_by, symbol_edges, type_relatives, type_families, class_tree, unit_deps, unit_dependency_counts, topo_order, impact, references, read_unit, context_pack)}

_U = r"regexp_replace(replace(trim(unit), '\', '/'), '^(?:\./+)+', '')"
_BARE = "lower(trim(regexp_extract({0}, '[^.]*$')))"
_COMMON = ", ".join(f"'{x}'" for x in G.COMMON)
_EDGES = f"""{CUR},
best AS (SELECT collection, unit, {_BARE.format("name")} AS bare, arg_min(id, (CASE WHEN kind = 'method' THEN 0 ELSE 1 END, id)) AS id, min(id) AS first_id FROM cur WHERE kind IN ('method', 'decl', 'type') GROUP BY 1, 2, 3),
idx AS (SELECT * FROM best WHERE bare <> ''),
calls AS (SELECT collection, id AS caller_id, {_CALLS} AS l FROM cur WHERE kind = 'method'),
names AS (SELECT collection, caller_id, unnest({_FIRST.format("l")}) AS bare FROM calls),
edges AS (SELECT collection, caller_id, idx.id AS callee_id, min(bare) AS name FROM names JOIN idx USING (collection, bare) WHERE bare NOT IN ({_COMMON}) AND caller_id <> idx.id GROUP BY 1, 2, 3)"""
_STEM = r"lower(regexp_replace(regexp_extract(unit, '[^/]*$'), '(.)\.[^.]*$', '\1'))"
_DEPS = rf"""{CUR}, units AS (SELECT DISTINCT collection, {_U} AS unit FROM cur), st AS (SELECT collection, {_STEM} AS stem, min(unit) AS target FROM units GROUP BY 1, 2),
uses AS (SELECT DISTINCT collection, {_U} AS unit, unnest(uses_list) AS used FROM cur WHERE kind = 'unithead'),
deps AS (SELECT u.collection, u.unit, used, coalesce(a.target, b.target, c.target) AS target FROM uses u LEFT JOIN st a ON a.collection = u.collection AND a.stem = lower(used)
  LEFT JOIN st b ON b.collection = u.collection AND b.stem = lower(regexp_extract(used, '[^.]*$')) LEFT JOIN st c ON c.collection = u.collection AND c.stem = lower(regexp_extract(used, '[^/]*$')) WHERE used IS NOT NULL)"""

ORACLE = {
    "call_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "called_by": f"""WITH {_EDGES}
SELECT collection, callee_id, count(*) AS n_callers, string_agg(caller_id::VARCHAR, ',' ORDER BY caller_id) AS callers FROM edges GROUP BY 1, 2""",
    "symbol_edges": f"""WITH {CUR}, t AS (SELECT collection, id, lang, trim(name) AS cn, unnest(extends_list) AS pn, generate_subscripts(extends_list, 1) - 1 AS pos FROM cur WHERE kind = 'type'),
e AS (SELECT collection, CASE WHEN coalesce(lang, '') = 'rust' THEN 'implements' WHEN regexp_matches(cn, '^I[A-Z]') OR pos = 0 THEN 'inherits' ELSE 'implements' END AS edge, lower(cn) AS child, lower(trim(pn)) AS parent, max(id) AS child_id
  FROM t WHERE cn <> '' AND trim(pn) <> '' AND lower(cn) <> lower(trim(pn)) GROUP BY ALL),
i AS (SELECT collection, lower(trim(name)) AS parent, min(id) AS parent_id FROM cur WHERE kind = 'type' GROUP BY 1, 2) SELECT e.*, parent_id FROM e LEFT JOIN i USING (collection, parent)""",
    "type_relatives": f"""WITH RECURSIVE {_TREE}, one AS (SELECT src_collection, p AS node_name, count(*) AS n_children FROM link GROUP BY 1, 2),
two AS (SELECT a.src_collection, a.p AS node_name, count(*) AS n_grandchildren FROM link a JOIN link b ON a.src_collection = b.src_collection AND a.c = b.p GROUP BY 1, 2)
SELECT src_collection, node_name, least(greatest(tree_depth, 0), 12)::BIGINT AS n_ancestors, coalesce(n_children, 0) AS n_children, coalesce(n_grandchildren, 0) AS n_grandchildren
FROM tree LEFT JOIN one USING (src_collection, node_name) LEFT JOIN two USING (src_collection, node_name)""",
    "type_families": f"""WITH RECURSIVE {_TREE}, l AS (SELECT src_collection || '|' || c AS a, src_collection || '|' || p AS b FROM link WHERE c <> p), both_ AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a, a AS r FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON both_.a = reach.r) SELECT a AS node, min(r) AS component FROM reach GROUP BY a""",
    "class_tree": f"""WITH RECURSIVE {_TREE}, k AS (SELECT src_collection, c FROM types WHERE c IS NOT NULL)
SELECT k.src_collection, k.c AS child, l.p AS parent, l.p IS NOT NULL AND o.c IS NULL AS external, row_number() OVER (PARTITION BY k.src_collection, l.p ORDER BY k.c) AS place
FROM k LEFT JOIN link l ON l.src_collection = k.src_collection AND l.c = k.c LEFT JOIN k o ON o.src_collection = k.src_collection AND o.c = l.p""",
    "unit_deps": f"WITH {_DEPS} SELECT * FROM deps",
    "unit_dependency_counts": """WITH r AS (SELECT DISTINCT src_collection AS collection, lower(trim(child_name)) AS unit, lower(trim(parent_name)) AS target FROM symbol_edges WHERE edge = 'uses' AND trim(child_name) <> '' AND trim(parent_name) <> '' AND lower(trim(child_name)) <> lower(trim(parent_name))),
a AS (SELECT collection, unit, count(*) AS n_uses FROM r GROUP BY 1, 2), b AS (SELECT collection, target AS unit, count(*) AS n_used_by FROM r GROUP BY 1, 2)
SELECT collection, unit, coalesce(n_uses, 0) AS n_uses, coalesce(n_used_by, 0) AS n_used_by FROM a FULL JOIN b USING (collection, unit)""",
    "impact": f"""WITH RECURSIVE {_EDGES}, inh AS{_TREE.split("inh AS", 1)[1]},
hit AS (SELECT collection, id, kind, lower(trim(name)) AS name FROM (SELECT *, {_U} AS u FROM cur) WHERE regexp_matches(lower(regexp_extract(u, '[^/]*$')), '^[abc]')),
ids AS (SELECT collection, lower(trim(name)) AS c, min(id) AS child_id FROM cur WHERE kind = 'type' GROUP BY 1, 2),
got AS (SELECT e.collection, caller_id AS id, 'caller' AS reason FROM edges e JOIN hit h ON h.collection = e.collection AND h.id = e.callee_id AND h.kind = 'method'
  UNION SELECT l.src_collection, child_id, 'subtype' FROM link l JOIN hit h ON h.collection = l.src_collection AND h.name = l.p AND h.kind = 'type' JOIN ids ON ids.collection = l.src_collection AND ids.c = l.c)
SELECT * FROM got WHERE (collection, id) NOT IN (SELECT collection, id FROM hit)""",
    "references": f"""WITH {_EDGES}, n AS (SELECT DISTINCT collection, {_BARE.format("x")} AS name FROM (SELECT collection, unnest(expected_names) AS x FROM eval_items)),
c AS (SELECT collection, id, kind, {_BARE.format("name")} AS bare, unnest(list_distinct(regexp_extract_all(lower(coalesce(code, '')), '[a-z_][a-z0-9_]*'))) AS w FROM cur),
d AS (SELECT n.collection, n.name, cur.id, cur.kind FROM n JOIN cur ON cur.collection = n.collection AND {_BARE.format("cur.name")} = n.name),
dn AS (SELECT collection, name, count(*) AS n_definitions FROM d GROUP BY 1, 2), tx AS (SELECT n.collection, n.name, count(*) AS n_textual FROM n JOIN c ON c.collection = n.collection AND c.w = n.name AND (c.bare IS NULL OR c.bare <> n.name) GROUP BY 1, 2),
cl AS (SELECT d.collection, d.name, count(DISTINCT caller_id) AS n_callers FROM d JOIN edges e ON e.collection = d.collection AND e.callee_id = d.id WHERE d.kind = 'method' GROUP BY 1, 2)
SELECT collection, name, coalesce(n_definitions, 0) AS n_definitions, coalesce(n_textual, 0) AS n_textual, coalesce(n_callers, 0) AS n_callers FROM n LEFT JOIN dn USING (collection, name) LEFT JOIN tx USING (collection, name) LEFT JOIN cl USING (collection, name)""",
    "read_unit": f"""WITH {CUR}, p AS (SELECT collection, {_U} AS unit, id, coalesce(line_start, 0) AS line, '# ' || coalesce(name, '') || chr(10) || coalesce(code, '') AS part FROM cur WHERE unit IS NOT NULL)
SELECT collection, unit, count(*) AS n_chunks, count(*) AS n_used, false AS truncated, md5(string_agg(part, chr(10) ORDER BY line, id)) AS content FROM p GROUP BY 1, 2""",
    "context_pack": f"""WITH RECURSIVE {_EDGES}, own AS (SELECT DISTINCT collection, callee_id AS root FROM edges),
parts AS (SELECT collection, root, 0 AS o, root AS id FROM own
  UNION ALL SELECT collection, callee_id, 1, caller_id FROM (SELECT *, row_number() OVER (PARTITION BY collection, callee_id ORDER BY caller_id) AS n FROM edges) WHERE n <= 12
  UNION ALL SELECT collection, caller_id, 2, callee_id FROM (SELECT e.*, row_number() OVER (PARTITION BY e.collection, caller_id ORDER BY callee_id) AS n FROM edges e JOIN own ON own.collection = e.collection AND own.root = caller_id) WHERE n <= 12),
sec AS (SELECT p.collection, root, concat_ws('|', name, cur.id::VARCHAR) AS title, length(code) AS n, row_number() OVER (PARTITION BY p.collection, root ORDER BY o, p.id) AS k FROM parts p JOIN cur ON cur.id = p.id AND cur.collection = p.collection),
fold AS (SELECT collection, root, 0::BIGINT AS k, 0::BIGINT AS used, []::VARCHAR[] AS kept, []::VARCHAR[] AS omitted FROM own
  UNION ALL SELECT f.collection, f.root, s.k, CASE WHEN used + n <= 2000 THEN used + n ELSE used END, CASE WHEN used + n <= 2000 THEN list_append(kept, title) ELSE kept END, CASE WHEN used + n <= 2000 THEN omitted ELSE list_append(omitted, title) END
  FROM fold f JOIN sec s ON s.collection = f.collection AND s.root = f.root AND s.k = f.k + 1)
SELECT collection, root, used AS used_chars, used // 4 AS used_tokens, array_to_string(kept, ',') AS kept, array_to_string(omitted, ',') AS omitted FROM fold QUALIFY row_number() OVER (PARTITION BY collection, root ORDER BY k DESC) = 1""",
}
