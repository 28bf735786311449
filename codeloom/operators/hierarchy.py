"""Parent links of unknown depth to roots, depths, paths and descendants.

Tree contraction: each round rakes the leaves and splices out an independent
set of nodes that have one child left. What is taken away is recorded with the
node it hung on and the number of steps between, so the rounds are played back
in reverse order once only roots are left. Long chains shrink by a constant
factor a round, so depth costs logarithmically many rounds. On a cycle the
contraction ends in a node that is its own parent and never goes away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.model import current, type_name
from codeloom.operators.skew import heavy_keys, salted_join
from codeloom.session import Scratch

CYCLE = "(cycle)"


def _round(alive: DataFrame, turn: int) -> DataFrame:
    """alive(n, p, w, seg) with what this round does to each row: keep, rake or splice.

    ``seg`` lists the original nodes from n up to, and without, p; ``kid`` is the one child of a spliced node.
    """
    kids = alive.where("n <> p").groupBy(F.col("p").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("kid"))
    rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))
    loop = F.col("n") == F.col("p")
    # of two neighbours at most one has the lower rank, so no two neighbours go at once
    spliced = ~loop & (F.col("k") == 1) & (rank("n") < rank("p")) & (rank("n") < rank("kid"))
    a = alive.join(kids, "n", "left")
    return a.withColumn("what", F.when(F.col("k").isNull() & ~loop, "rake").when(spliced, "splice").otherwise("keep"))


def _after(done: DataFrame) -> DataFrame:
    """The rows that a round keeps, with links past the nodes it spliced out."""
    went = done.where("what = 'splice'").select(F.col("kid").alias("n"), F.col("p").alias("to"), F.col("w").alias("add"), F.col("seg").alias("more"))
    return done.where("what = 'keep'").join(went, "n", "left").select(
        "n", F.coalesce("to", "p").alias("p"), (F.col("w") + F.coalesce("add", F.lit(0))).alias("w"),
        F.when(F.col("to").isNull(), F.col("seg")).otherwise(F.concat("seg", "more")).alias("seg"),
    )


def _records(done: DataFrame) -> DataFrame:
    """What a round took away, hung on nodes that outlived it."""
    went = done.where("what = 'splice'").select("n", "p", "w", "seg")
    via = went.select(F.col("n").alias("p"), F.col("p").alias("to"), F.col("w").alias("add"), F.col("seg").alias("more"))
    raked = done.where("what = 'rake'").select("n", "p", "w", "seg").join(via, "p", "left").select(
        "n", F.coalesce("to", "p").alias("p"), (F.col("w") + F.coalesce("add", F.lit(0))).alias("w"),
        F.when(F.col("to").isNull(), F.col("seg")).otherwise(F.concat("seg", "more")).alias("seg"),
    )
    return went.union(raked)


def contract(links: DataFrame, nodes: DataFrame, paths: bool = True) -> DataFrame:
    """Resolve every node of a forest that may contain cycles.

    ``links`` has n and p, one row per child; ``nodes`` has n, with whatever else
    shall be resolved. Keys may be of any one type, not null. Returns n, root,
    depth and, with ``paths``, path (root first) and trail (the way up: the node itself, its parent and so on, each
    node once). Nodes on a cycle or below one get a null root, depth -1 and a null path; their trail goes once round
    the cycle. Rows in ``links`` with a null end are no links; a node
    without link is a root.

    Every round takes away at least one node that isn't its own parent (a leaf, or on a bare cycle the node of least rank), so
    the rounds come to an end by themselves.
    """
    spark = links.sparkSession
    kept = Scratch(spark, "hierarchy")
    seg = F.array("n") if paths else F.lit(None).cast("array<string>")
    links = links.where("n is not null and p is not null").select("n", "p").dropDuplicates(["n"])
    alive = kept.put(links.select("n", "p", F.lit(1).cast("long").alias("w"), seg.alias("seg")), "alive0")
    hubs = heavy_keys(alive, "p")
    first, parents = alive.select("n"), alive.select(F.col("p").alias("n")).distinct()
    none = F.lit(None).cast("array<string>")
    # roots with children are what the replay starts from; nodes without any link are told apart, they are never looked up
    top = lambda df: df.select("n", F.col("n").alias("root"), F.lit(0).cast("long").alias("depth"), (F.array("n") if paths else none).alias("path"))
    tops = kept.put(top(parents.join(first, "n", "left_anti")), "tops")
    lone = nodes.select("n").where("n is not null").distinct().join(first.union(parents), "n", "left_anti")

    turn = 0
    while True:
        done = kept.put(_round(alive, turn), f"round{turn}")
        alive = _after(done)
        turn += 1
        if done.where("what = 'keep' and n <> p").isEmpty():
            break

    # what is left are nodes that are their own parents: each stands for a cycle, and its segment lists it
    known = tops.union(kept.put(alive.select("n", F.lit(None).cast(links.schema["n"].dataType).alias("root"), F.lit(-1).cast("long").alias("depth"), (F.reverse("seg") if paths else none).alias("path")), "cores"))
    parts = [known]
    for t in range(turn - 1, -1, -1):
        # a record's parent left later than the record, so it is among what is known by now
        step = salted_join(_records(spark.read.parquet(f"{kept.base}/round{t}")), _union(parts).select(F.col("n").alias("p"), "root", "depth", "path"), "p", hubs)
        path = F.concat("path", F.reverse("seg")) if paths else none
        parts.append(kept.put(step.select("n", "root", F.when(F.col("depth") >= 0, F.col("depth") + F.col("w")).otherwise(-1).alias("depth"), path.alias("path")), f"back{t}"))
        kept.drop(f"round{t}")
    out = kept.put(_union([*parts, top(lone)]), "resolved")
    kept.drop("alive0", "tops", "cores", *[f"back{t}" for t in range(turn)])
    if not paths:
        return out.drop("path")
    return out.select("n", "root", "depth", F.when(F.col("depth") >= 0, F.col("path")).alias("path"), F.array_distinct(F.reverse("path")).alias("trail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def type_links(edges: DataFrame) -> DataFrame:
    """src_collection, child, parent: each type's latest inherits edge that names a parent."""
    e = edges.where("edge = 'inherits'").select("src_collection", type_name(F.coalesce("child_name", "child_display")).alias("child"), type_name(F.coalesce("parent_name", "parent_display")).alias("parent"), "recorded_at", "edge_id")
    latest = F.max(F.struct("recorded_at", "edge_id", "parent")).alias("m")
    return e.where("child is not null and parent is not null").groupBy("src_collection", "child").agg(latest).select("src_collection", "child", "m.parent")


def collection_types(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """src_collection, child: the types of a collection, from current type chunks and inherits edges."""
    t = current(chunks.select("id", "indexed_at", "kind", "collection", F.when(F.col("kind") == "type", F.col("name")).alias("name")), ["kind", "collection", "name"]).where("kind = 'type'")
    named = t.select(F.col("collection").alias("src_collection"), type_name(F.col("name")).alias("child"))
    children = edges.where("edge = 'inherits'").select("src_collection", type_name(F.coalesce("child_name", "child_display")).alias("child"))
    return named.union(children).where("child is not null").distinct()


def type_hierarchy(chunks: DataFrame, edges: DataFrame, paths: bool = True) -> DataFrame:
    """src_collection, node_name, root_name, tree_depth and, with paths, path (names, root first) and trail (names, the way up).

    One row per type of a collection. On a cycle or below one root_name is
    ``(cycle)``, tree_depth -1 and path null. Blank names and names that are empty without
    their type arguments are no types; a null collection is a collection of its own.
    """
    sep = "\x01"
    key = lambda c: F.concat(F.coalesce("src_collection", F.lit("")), F.lit(sep), F.col(c))
    bare = lambda c: F.substring_index(c, sep, -1)
    types = Scratch(chunks.sparkSession, "types").put(collection_types(chunks, edges), "types")  # read twice
    found = contract(type_links(edges).select(key("child").alias("n"), key("parent").alias("p")), types.select(key("child").alias("n")), paths)
    out = types.withColumn("n", key("child")).join(found, "n")
    cols = ["src_collection", F.col("child").alias("node_name"), F.coalesce(bare("root"), F.lit(CYCLE)).alias("root_name"), F.col("depth").alias("tree_depth")]
    names = lambda c: F.transform(c, lambda x: F.substring_index(x, sep, -1)).alias(c)
    return out.select(*cols, *([names("path"), names("trail")] if paths else []))


def descendants(hierarchy: DataFrame) -> DataFrame:
    """src_collection, node_name, descendant, distance: one row for each node and each type below it.

    On a cycle every type is below every other, as many steps away as the first walk up takes; what hangs on a cycle is below all of it.
    Rows instead of one array per node, so that a root with very many descendants is no single row. The result itself has depth-many
    rows per type.
    """
    up = hierarchy.select("src_collection", F.col("node_name").alias("descendant"), F.posexplode("trail").alias("distance", "node_name")).where("distance > 0")
    return up.select("src_collection", "node_name", "descendant", F.col("distance").cast("long").alias("distance"))
