"""Queries of the two general problems: heavy keys and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.model import table
from codeloom.operators import hierarchy as H
from codeloom.operators import skew as S


def p2_found(spark, d):
    return S.dominant_keys(S.reference_counts(table(spark, d, "chunks")))


def p2_reference_counts(spark, d):
    return S.reference_counts(table(spark, d, "chunks"))


def _types(spark, d, paths):
    return H.type_hierarchy(table(spark, d, "chunks"), table(spark, d, "symbol_edges"), paths)


def p5_found(spark, d):
    return _types(spark, d, False).select("src_collection", "node_name", "root_name", "tree_depth")


def p5_paths(spark, d):
    return _types(spark, d, True).select("src_collection", "node_name", "root_name", "tree_depth", F.array_join("path", " > ").alias("path"))


def p5_descendants(spark, d):
    return H.descendants(_types(spark, d, True))


QUERIES = {f.__name__: f for f in (p2_found, p2_reference_counts, p5_found, p5_paths, p5_descendants)}

_CUR = "cur AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) = 1)"
_REFS = f"""{_CUR},
refs AS (SELECT 'calls' AS side, id, r.id AS key_id FROM (SELECT id, unnest(calls) AS r FROM cur)
  UNION ALL SELECT 'called_by', id, r.id FROM (SELECT id, unnest(called_by) AS r FROM cur)),
counts AS (SELECT side, key_id, count(*)::BIGINT AS n_references, count(DISTINCT id)::BIGINT AS n_chunks FROM refs WHERE key_id IS NOT NULL GROUP BY ALL)"""
_NAME = "nullif(lower(trim(regexp_extract(regexp_replace({}, '<.*$', ''), '([^.]*)$', 1))), '')"
_TREE = f"""{_CUR},
inh AS (SELECT src_collection, {_NAME.format("coalesce(child_name, child_display)")} AS c, {_NAME.format("coalesce(parent_name, parent_display)")} AS p, recorded_at, edge_id
  FROM symbol_edges WHERE edge = 'inherits'),
link AS (SELECT src_collection, c, p FROM inh WHERE c IS NOT NULL AND p IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY src_collection, c ORDER BY recorded_at DESC, edge_id DESC, p DESC) = 1),
types AS (SELECT collection AS src_collection, {_NAME.format("name")} AS c FROM cur WHERE kind = 'type'
  UNION SELECT src_collection, c FROM inh),
walk AS (SELECT src_collection, c, c AS at, 0 AS d, [c] AS path FROM types WHERE c IS NOT NULL
  UNION ALL SELECT w.src_collection, w.c, l.p, w.d + 1, list_prepend(l.p, w.path) FROM walk w JOIN link l ON l.src_collection = w.src_collection AND l.c = w.at WHERE w.d < 200),
tops AS (SELECT w.src_collection, w.c, w.at, w.d, w.path FROM walk w LEFT JOIN link l ON l.src_collection = w.src_collection AND l.c = w.at WHERE l.c IS NULL),
tree AS (SELECT t.src_collection, t.c AS node_name, coalesce(w.at, '(cycle)') AS root_name, coalesce(w.d, -1)::BIGINT AS tree_depth, w.path
  FROM types t LEFT JOIN tops w ON w.src_collection = t.src_collection AND w.c = t.c WHERE t.c IS NOT NULL)"""

ORACLE = {
    "p2_found": f"WITH {_REFS} SELECT side, key_id FROM counts QUALIFY n_references >= 0.03 * sum(n_references) OVER (PARTITION BY side)",
    "p2_reference_counts": f"WITH {_REFS} SELECT * FROM counts",
    "p5_found": f"WITH RECURSIVE {_TREE} SELECT src_collection, node_name, root_name, tree_depth FROM tree",
    "p5_paths": f"WITH RECURSIVE {_TREE} SELECT src_collection, node_name, root_name, tree_depth, array_to_string(path, ' > ') AS path FROM tree",
    "p5_descendants": f"""WITH RECURSIVE {_TREE},
up AS (SELECT t.src_collection, t.c AS descendant, l.p AS node_name, 1 AS distance, [t.c, l.p] AS seen FROM types t JOIN link l ON l.src_collection = t.src_collection AND l.c = t.c WHERE l.p <> t.c
  UNION ALL SELECT u.src_collection, u.descendant, l.p, u.distance + 1, list_append(u.seen, l.p) FROM up u JOIN link l ON l.src_collection = u.src_collection AND l.c = u.node_name WHERE NOT list_contains(u.seen, l.p))
SELECT src_collection, node_name, descendant, distance::BIGINT AS distance FROM up""",
}
