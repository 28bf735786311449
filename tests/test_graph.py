from codeloom.operators import graph as G
from codeloom.plans import graphs, indexing


def test_edges_are_whole(spark):
    """A caller with 60 names, the last of them behind character 4,000, and a name that 10 units have."""
    calls = [f"Call{i}" for i in range(60)]
    code = "".join(f"  {n}(1);\n" for n in calls[:-1]) + "x" * 5_000 + f"\n  {calls[-1]}(2);\n"
    rows = [(0, "c", "main.pas", "method", "TMain.Go", code)]
    rows += [(100 + i, "c", f"u{i}.pas", "method", n, "") for i, n in enumerate(calls)]
    rows += [(200 + i, "c", f"v{i}.pas", "method", calls[0], "") for i in range(9)]
    df = spark.createDataFrame(rows, "id bigint, collection string, unit string, kind string, name string, code string")
    e = G.call_edges(df)
    assert {(r.caller_id, r.callee_id) for r in e.collect()} == {(0, i) for i in [*range(100, 160), *range(200, 209)]}
    assert G.call_edges(df, capped=True).count() == 50 + 7
    many = spark.createDataFrame([("c", i, 1) for i in range(20)], "collection string, caller_id bigint, callee_id bigint")
    assert G.called_by(many, cap=None).first().callers == list(range(20))


def test_twins_have_no_caps():
    for name, sql in {**graphs.ORACLE, **indexing.ORACLE}.items():
        if name in ("extract_calls", "call_edges", "called_by", "impact", "references", "context_pack", "read_unit"):
            assert not any(x in sql for x in ("[1:4000]", "[1:50]", "<= 8", "<= 16"))


def test_units_are_read_whole(spark, tmp_path):
    from codeloom.operators import documents

    rows = [(i, "c", "u.pas", "method", f"M{i}", i, "x" * 1_500) for i in range(4)]
    df = spark.createDataFrame(rows, "id bigint, collection string, unit string, kind string, name string, line_start int, code string")
    full = df.selectExpr("*", "cast(null as string) as doc", "cast(null as string) as lang", "array('') as uses_list", "array('') as extends_list", "timestamp'2024-01-01' as indexed_at")
    full.write.parquet(f"{tmp_path}/chunks.parquet")
    r = graphs.read_unit(spark, str(tmp_path)).first()
    assert (r.n_chunks, r.n_used, r.truncated) == (4, 4, False)
    long = df.selectExpr("collection", "unit", "id", "name", "line_start", "repeat(code, 300) as code")
    r = documents.read_unit(long, cap=None).first()
    assert (r.n_used, r.truncated, len(r.content)) == (4, False, 4 * (450_000 + 5) + 3)
