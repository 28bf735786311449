import pytest

from codeloom.operators import graph as G
from codeloom.operators import lifecycle as L
from codeloom.sources import files


def test_generations(spark, tmp_path):
    g = L.Generations(spark, f"file://{tmp_path}/ds")
    assert g.current() is None
    g.write(spark.range(1))
    n = g.write(spark.range(2), swap=False)
    assert g.read().count() == 1  # not visible before the swap
    g.swap(n)
    assert g.read().count() == 2
    g.write(spark.range(3))
    assert g.numbers() == [2, 3]  # the current one and one older
    g.swap(2)
    assert g.read().count() == 2
    with pytest.raises(ValueError):
        g.swap(9)


def test_export_round_trip_and_wrong_count(spark, tmp_path):
    df = spark.createDataFrame([(1, "ü", [1.5]), (2, None, None)], "id bigint, name string, v array<double>")
    L.export(df, f"file://{tmp_path}/x", "t")
    assert sorted(L.import_rows(spark, f"file://{tmp_path}/x").collect()) == sorted(df.collect())
    spark.createDataFrame([('{"id":3}',)], "value string").write.mode("append").text(f"file://{tmp_path}/x/rows")
    with pytest.raises(ValueError):
        L.import_rows(spark, f"file://{tmp_path}/x")


def test_diff_with_null_hashes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, None)], "id int, h string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (5, "x")], "id int, h string")
    got = {r.id: r.status for r in L.diff(old, new, ["id"], "h").collect()}
    assert got == {1: "unchanged", 2: "changed", 3: "unchanged", 4: "deleted", 5: "new"}


def test_source_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.pas").write_text("unit a;\r\nuses b;\r\nend.")
    (tmp_path / "src/b.bin").write_text("x")
    t = files.source_tree(spark, f"file://{tmp_path}", "*.pas, *.bin, *")
    r = t.collect()
    assert [(x.unit, x.lang) for x in r] == [("src/a.pas", "pascal")]
    from pyspark.sql import functions as F

    assert t.select(files.line_slice(F.col("content"), F.lit(2), F.lit(3))).first()[0] == "uses b;\nend."
    assert files.is_dirty(t, "2000-01-01")


def test_chunk_lines_last_wins(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": 1, "name": "old"}\n{"id": 2, "name": "x"}\n{"id": 1, "name": "new"}\n')
    got = files.chunk_lines(spark, f"file://{tmp_path}/c.jsonl", "id bigint, name string").collect()
    assert sorted((r.id, r.name) for r in got) == [(1, "new"), (2, "x")]


def test_layers(spark):
    deps = spark.createDataFrame([("c", "app", "lib"), ("c", "lib", "base"), ("c", "tool", "base"), ("c", "x", "y"), ("c", "y", "x"), ("c", "z", "x"), ("c", "lib", None)], "collection string, unit string, target string")
    got = {r.unit: r.layer for r in G.topological_layers(deps).collect()}
    assert got == {"base": 0, "lib": 1, "tool": 1, "app": 2, "x": -1, "y": -1, "z": -1}


def test_units_resolve_by_name_then_last_segments(spark):
    units = spark.createDataFrame([("c", "a/Sys.Utils.pas"), ("c", "b/Utils.pas"), ("c", "b/net.go")], "collection string, unit string")
    uses = spark.createDataFrame([("c", "m", "Sys.Utils"), ("c", "m", "X.Utils"), ("c", "m", "github/x/net"), ("c", "m", "none")], "collection string, unit string, used string")
    got = {r.used: r.target for r in G.resolve_units(uses, units).collect()}
    assert got == {"Sys.Utils": "a/Sys.Utils.pas", "X.Utils": "b/Utils.pas", "github/x/net": "b/net.go", "none": None}


def test_duplicate_code_has_a_row_per_member(spark, tmp_path):
    from codeloom.plans import indexing

    code = "x := 1; " * 50
    rows = [(i, "c", f"u{i}.pas", "method", code if i < 3 else f"{code}{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, collection string, unit string, kind string, code string").selectExpr("*", "timestamp'2024-01-01' as indexed_at")
    df.write.parquet(f"{tmp_path}/chunks.parquet")
    assert {tuple(r) for r in indexing.duplicate_code_members(spark, str(tmp_path)).collect()} == {(i, 0, 3, 3) for i in range(3)}
