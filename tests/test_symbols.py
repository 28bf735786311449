import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import lifecycle as L
from codeloom.operators import symbols as Y


def one(spark, column, **values):
    row = spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v))).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_texts(spark):
    assert one(spark, T.without_unit(F.col("t"), F.col("u")), t="Open (src/a.pas)", u="src/a.pas") == "Open"
    assert one(spark, T.without_unit(F.col("t"), F.col("u")), t="Open (x)", u="src/a.pas") == "Open (x)"
    assert one(spark, T.js_escape(F.col("t")), t="it's \\ <b>") == "it\\&#x27;s \\\\ &lt;b&gt;"
    assert one(spark, T.strict_base64(F.col("t")), t="aGk=") == b"hi"
    assert one(spark, T.strict_base64(F.col("t")), t="aGk") is None and one(spark, T.strict_base64(F.col("t")), t="a Gk=") is None
    link = lambda t, names, own: one(spark, T.link_names(F.col("t"), F.col("n"), F.lit(own)), t=t, n=names)
    assert link("TFoo and TFooBar, not `TFoo` nor TSelf", ["TFoo", "TFooBar", "TSelf"], "TSelf") == "[TFoo](#TFoo) and [TFooBar](#TFooBar), not `TFoo` nor TSelf"
    assert link("a + b", ["a+"], "x") == "a + b" and link("a", [""], "x") == "a"


def test_index_run_replaces_stale_rows_at_once(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "x")], "id long, h string, v string")
    new = spark.createDataFrame([(1, "a", "y"), (2, "B", "y"), (4, None, "y"), (4, "d", "z")], "id long, h string, v string")
    g = L.Generations(spark, f"file://{tmp_path}/g")
    state, counts = L.index_run(old, new, "id", "h", g)
    assert sorted(map(tuple, state.collect())) == [(1, "a", "x"), (2, "B", "y"), (4, "d", "z")]
    assert {r.status: r.n for r in counts.collect()} == {"unchanged": 1, "changed": 1, "new": 1, "deleted": 1}
    assert g.current() == 1 and g.read().count() == 3
    assert L.index_run(old.limit(0), new.limit(0), "id", "h")[0].count() == 0


def test_ids_and_names_move_with_their_edges(spark):
    c = spark.createDataFrame([(1, "method"), (2, "method"), (3, "method_part")], "id long, kind string")
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 9)], "caller_id long, callee_id long")
    moved, edges = L.migrate_ids(c, F.col("id") + 100, e)
    assert sorted(r.id for r in moved.collect()) == [3, 101, 102]
    assert sorted((r.caller_id, r.callee_id) for r in edges.collect()) == [(101, 102), (102, 101)]
    t = {"p": spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "collection string, n int")}
    assert {r.collection for r in L.rename_collection(t, {"p": "collection"}, "a", "z")["p"].collect()} == {"z", "b", None}
    assert {r.n for r in L.rename_collection(t, {"p": "collection"}, "a", None)["p"].collect()} == {2, 3}
    with pytest.raises(ValueError):
        L.rename_collection(t, {"p": "collection"}, "a", "b")


def test_lines_are_appended_and_keep_letters(spark, tmp_path):
    df = spark.createDataFrame([(1, "ğ")], "id int, t string")
    L.write_lines(df, f"{tmp_path}/log")
    L.write_lines(df, f"{tmp_path}/log", append=True)
    assert [r.value for r in spark.read.text(f"{tmp_path}/log").collect()] == ['{"id":1,"t":"ğ"}'] * 2
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    new = spark.createDataFrame([("a", None, ""), ("c", 3, "z")], "k string, n int, s string")
    assert {tuple(r) for r in L.merge_fields(old, new, ["k"], ["n", "s"]).collect()} == {("a", 1, None), ("b", 2, "y"), ("c", 3, "z")}


def test_relations_of_a_large_unit_are_cut_by_line(spark):
    c = spark.createDataFrame([("c", "u", i, "method", 10 * i) for i in range(1, 8)], "collection string, unit string, id long, kind string, line_start int")
    e = spark.createDataFrame([("c", 1, 2)], "collection string, caller_id long, callee_id long")
    got = Y.relations(c, e, same_unit=3).collect()
    near = lambda i: [r.other for r in sorted(got, key=lambda r: r.place) if r.id == i and r.kind == "same_unit"]
    assert near(1) == [2, 3, 4] and near(2) == [1, 3, 4] and near(7) == [1, 2, 3]
    assert {(r.id, r.kind, r.other) for r in got if r.kind != "same_unit"} == {(1, "calls", 2), (2, "called_by", 1)}
