from codeloom.operators import analytics as A
from codeloom.operators import graph as G
from codeloom.operators import search as S
from codeloom.operators import skew
from codeloom.sources import files as X


def test_last_line_of_the_last_file_wins(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "first"}\n' + '{"id": 2, "v": "old"}\n{"id": 2, "v": "new"}\n' + '{"v": "none"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 1, "v": "%s"}\n' % ("x" * 5000) + '{"id": 3, "v": "z"}\n' * 50)
    got = {r.id: r.v for r in X.chunk_lines(spark, str(tmp_path), "id long, v string").collect()}
    assert got == {1: "x" * 5000, 2: "new", 3: "z"}


def test_globs_match_the_whole_relative_path(spark, tmp_path):
    for f in ("src/a.py", "src/deep/b.py", "other/b.py", "top.py", "src/x.txt"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x = 1\n")
    units = lambda p: sorted(r.unit for r in X.source_tree(spark, str(tmp_path), p).collect())
    assert units("src/*.py") == ["src/a.py"]
    assert units("src/**/*.py") == ["src/a.py", "src/deep/b.py"]
    assert units("*.py") == ["other/b.py", "src/a.py", "src/deep/b.py", "top.py"]
    assert units("t?p.py, other/*") == ["other/b.py", "top.py"] and units("./src/a.py") == ["src/a.py"]


def test_queries_of_several_lengths_each_find_theirs(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0] * 9)], "q_id long, v array<double>")
    for bound in (4_000_000, 2):
        assert {(r.q_id, r.id) for r in S.knn(v, q, top=2, max_matrix=bound).collect()} == {(10, 1), (10, 2), (11, 3)}


def test_layers_have_no_end_but_the_graphs(spark):
    deps = spark.createDataFrame([("c", f"u{i:02}", f"u{i + 1:02}") for i in range(12)] + [("c", "a", "b"), ("c", "b", "a"), (None, "x", "y")], "collection string, unit string, target string")
    got = {(r.collection, r.unit): (r.layer, r.place) for r in G.topological_layers(deps).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "c"} == {f"u{12 - i:02}": (i, i + 1) for i in range(13)} | {"a": (-1, 14), "b": (-1, 15)}


def test_places_by_ranges(spark):
    df = spark.range(500).selectExpr("id", "CASE WHEN id % 5 = 0 THEN NULL ELSE id % 2 END AS g", "(id * 7919) % 500 AS v")
    want = {}
    for r in sorted(df.collect(), key=lambda r: r.v):
        want.setdefault(r.g, []).append(r.id)
    got = {(r.g, r.place): r.id for r in skew.ranked(df, ["g"], ["v"]).collect()}
    assert got == {(g, i + 1): x for g, xs in want.items() for i, x in enumerate(xs)}


def test_percentiles_of_skewed_groups(spark):
    rows = [("a", float(x % 7)) for x in range(1000)] + [("b", 1.0), ("b", 2.0), ("c", 5.0), ("c", None), (None, 3.0)]
    got = {r.m: (r.p50, r.p95) for r in A.latency(spark.createDataFrame(rows, "m string, ms double"), "m", "ms").collect()}
    assert got == {"a": (3.0, 6.0), "b": (1.5, 1.0), "c": (5.0, 5.0), None: (3.0, 3.0)}
