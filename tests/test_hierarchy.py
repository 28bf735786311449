import datetime
import random

from codeloom.operators import hierarchy as H
from codeloom.operators.components import connected_components


def solve(parent, nodes):
    out = {}
    for n in nodes:
        path, at = [n], n
        while at in parent and parent[at] not in path:
            at = parent[at]
            path.append(at)
        out[n] = (None, -1, None) if at in parent else (at, len(path) - 1, path[::-1])
    return out


def check(spark, parent, extra=()):
    nodes = sorted({*parent, *parent.values(), *extra})
    links = spark.createDataFrame(list(parent.items()), "n string, p string")
    got = H.contract(links, spark.createDataFrame([(n,) for n in nodes], "n string"))
    assert {r.n: (r.root, r.depth, r.path) for r in got.collect()} == solve(parent, nodes)


def test_chain_tree_and_cycles(spark):
    parent = {f"c{i}": f"c{i + 1}" for i in range(70)}  # a long chain
    parent |= {f"l{i}": "hub" for i in range(40)} | {"hub": "top"}  # a hub
    parent |= {"x": "y", "y": "x", "z": "x", "self": "self", "below": "self"}  # cycles and what hangs below
    parent |= {f"r{i}": f"r{(i + 1) % 9}" for i in range(9)}
    check(spark, parent, extra=["alone"])


def test_random_forest_with_cycles(spark):
    rnd = random.Random(5)
    parent = {f"n{i}": f"n{rnd.randrange(200)}" for i in range(200) if rnd.random() < 0.85}
    check(spark, parent)


def test_empty_and_null_links(spark):
    links = spark.createDataFrame([(None, "a"), ("b", None)], "n string, p string")
    nodes = spark.createDataFrame([("b",), (None,)], "n string")
    assert [(r.n, r.root, r.depth) for r in H.contract(links, nodes).collect()] == [("b", "b", 0)]
    assert H.contract(links.limit(0), nodes.limit(0)).count() == 0


def edge(i, child, parent, day, kind="inherits", coll="c"):
    return (i, coll, kind, child, child, 1, parent, parent, None, "u", datetime.datetime(2024, 1, day), None, "clash")


EDGES = "edge_id bigint, src_collection string, edge string, child_name string, child_display string, child_id bigint, parent_name string, parent_display string, parent_id bigint, unit string, recorded_at timestamp, arrived_at timestamp, node_name string"
CHUNKS = "id bigint, indexed_at timestamp, kind string, collection string, name string, root_name string"


def test_types_compare_by_normalised_names_and_latest_edges(spark):
    edges = spark.createDataFrame([
        edge(1, "Unit.TFoo<T>", "tbase", 1), edge(2, " TFOO ", "TOther<A<B>>", 2), edge(3, "TFoo", None, 3), edge(3, "TFoo", None, 3),
        edge(4, "TBar", "TFoo", 1), edge(5, "IX", "IY", 1, "implements"), edge(6, "", "TFoo", 1),
    ], EDGES)
    chunks = spark.createDataFrame([(1, datetime.datetime(2024, 1, 2), "type", "c", "TLone", ""), (1, datetime.datetime(2024, 1, 1), "type", "c", "TOld", ""), (2, None, "method", "c", "Run", "")], CHUNKS)
    got = {r.node_name: (r.root_name, r.tree_depth) for r in H.type_hierarchy(chunks, edges).collect()}
    assert got == {"tfoo": ("tother", 1), "tbar": ("tother", 2), "tlone": ("tlone", 0)}
    below = H.descendants(H.type_hierarchy(chunks, edges)).collect()
    assert {(r.node_name, r.descendant, r.distance) for r in below} == {("tother", "tfoo", 1), ("tother", "tbar", 2), ("tfoo", "tbar", 1)}
    assert H.type_hierarchy(chunks.limit(0), edges.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(500, 500 + i) for i in range(30)] + [(None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {x: find(x) for x in root}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_trails_go_once_round_a_cycle(spark):
    parent = {"a": "b", "b": "c", "c": "a", "low": "leaf", "leaf": "b", "x": "top", "self": "self"}
    nodes = sorted({*parent, *parent.values()})
    got = H.contract(spark.createDataFrame(list(parent.items()), "n string, p string"), spark.createDataFrame([(n,) for n in nodes], "n string"))

    def walk(n):
        out = [n]
        while n in parent and parent[n] not in out:
            n = parent[n]
            out.append(n)
        return out

    assert {r.n: r.trail for r in got.collect()} == {n: walk(n) for n in nodes}


def test_hub_of_most_links_is_salted(spark):
    parent = {f"k{i}": "hub" for i in range(3000)} | {"hub": "top"}
    nodes = spark.createDataFrame([(n,) for n in {*parent, "top"}], "n string")
    got = H.contract(spark.createDataFrame(list(parent.items()), "n string, p string"), nodes)
    assert {(r.root, r.depth) for r in got.where("n like 'k%'").collect()} == {("top", 2)} and got.count() == 3002
    comp = connected_components(spark.createDataFrame([(i, 5) for i in range(3000)] + [(9000, 9001)], "a long, b long"))
    assert {(r.component, r.n) for r in comp.groupBy("component").agg({"*": "count"}).toDF("component", "n").collect()} == {(0, 3000), (9000, 2)}


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    from codeloom.session import Scratch, scratch_dir

    Scratch.clear(spark)
    links = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(30)], "n string, p string")
    assert H.contract(links, links.select("n")).count() == 31
    left = [Path(b.removeprefix("file://")) for b in Scratch._left[spark.sparkContext.applicationId]]
    assert [b.parent for b in left] == [Path(scratch_dir(spark).removeprefix("file:").replace("///", "/"))]
    assert [p.name for p in left[0].iterdir()] == ["resolved"]
    Scratch.clear(spark)
    assert not left[0].exists()
