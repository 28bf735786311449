import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import search as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("name", "want"), [
    ("TDBGrid", ["tdb", "grid"]), ("TCRConnection", ["tcr", "connection"]), ("IHTTPClient", ["ihttp", "client"]), ("snake_case_name", ["snake", "case", "name"]),
    ("utf8Decode", ["utf8", "decode"]), ("", []), (None, []), ("şifreÇöz", ["şifre", "çöz"]),
])
def test_identifier_tokens(spark, name, want):
    assert one(spark, T.identifier_tokens(F.lit(name))) == want


def test_name_boost(spark):
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    boost = lambda q, n: one(spark, T.name_boost(arr(q), arr(n)))
    assert boost(["a", "b"], ["a", "b"]) == 3.0
    assert boost([], ["a"]) == boost(["a"], []) == boost(["a"], ["b"]) == 1.0
    noise = [boost(["a", "b"], ["a", "b", *"xyzuvw"[:i]]) for i in range(6)]
    assert noise == sorted(noise, reverse=True)
    assert len(set(noise)) == 6


def test_score_multiplier(spark):
    m = lambda c: one(spark, T.score_multiplier(F.lit(c).cast("double")))
    assert m(5.5) == m(None) == 1.0
    assert m(10) == m(99) == pytest.approx(1.12)
    assert m(1) == m(-5) == pytest.approx(0.88)
    assert m(1) * 1.0 > m(10) * 0.8 - 0.02


def test_context_window(spark):
    w = [one(spark, T.context_window(F.lit(n), F.lit(600))) for n in (0, 10_000, 20_000, 50_000, 10**6)]
    assert w == sorted(w)
    assert w[0] == 4096
    assert w[-1] == 16384


@pytest.mark.parametrize(("client", "path", "ok"), [("pc-1", "src/a.pas", True), ("pc-1", "../a", False), ("pc-1", "a/../b", False), ("pc 1", "a", False), ("x", "/a", False), ("x", "C:\\a", False), ("x", "a\\..\\b", False), ("x", "", False), ("..", "a", False), (None, "a", False), ("x", "a..b/c", True)])
def test_safe_path(spark, client, path, ok):
    assert one(spark, T.safe_path(F.lit(client), F.lit(path))) is ok


def test_small_functions(spark):
    assert one(spark, T.slug(F.lit("  Héllo, World! "))) == "h-llo-world"
    assert one(spark, T.slug(F.lit("!!"))) == "section"
    assert one(spark, T.json_array(F.lit('noise [1, [2]]\n tail'))) == "[1, [2]]"
    assert one(spark, T.url_origin(F.lit("https://u:p@Host.example/x?y"))) == "https://host.example"
    assert one(spark, T.url_origin(F.lit("http://169.254.1.1/"))) is None
    assert one(spark, T.url_origin(F.lit("ftp://a"))) is None


def test_diversify_equals_the_greedy_rule(spark):
    rnd = random.Random(1)
    units = [rnd.choice("aaaabbcdef") for _ in range(60)]
    df = spark.createDataFrame([(1, i + 1, u) for i, u in enumerate(units)], "q_id bigint, rank int, unit string")
    head, rest, n = [], [], {}
    for i, u in enumerate(units):
        if len(head) < 24 and n.get(u, 0) >= 3:
            rest.append(i + 1)
        else:
            n[u] = n.get(u, 0) + (len(head) < 24)
            head.append(i + 1)
    # once the head is full everything keeps its order behind it
    want = head[:24] + sorted(rest + head[24:], key=lambda r: (r not in rest, r))
    got = [r.rank for r in S.diversify(df).orderBy("new_rank").collect()]
    assert got[:24] == want[:24]
    assert sorted(got) == list(range(1, 61))


def test_pages_share_the_total_and_no_row(spark):
    df = spark.createDataFrame([(1, i) for i in range(1, 24)], "q_id int, rank int")
    a, b = S.page(df, 0, 10).collect(), S.page(df, 10, 10).collect()
    assert {r.total for r in a} == {r.total for r in b} == {23}
    assert not {r.rank for r in a} & {r.rank for r in b}
    assert a[0].has_more
    assert not S.page(df, 20, 10).first().has_more


def test_unknown_mode_means_both():
    assert S.mode_weights("whatever") == T.WEIGHTS
    assert S.mode_weights("dense") == {"dense": 1.0}


def test_decl_hands_its_doc_to_the_method(spark):
    df = spark.createDataFrame([
        (1, 1, "c", "u", "T.Run", "method", None), (1, 2, "c", "u", "Run", "decl", "first"), (1, 3, "c", "u", "run", "decl", "second"), (1, 4, "c", "v", "Run", "decl", None), (1, 5, None, None, None, None, None),
    ], "q_id int, rank int, collection string, unit string, name string, kind string, doc string")
    got = {r["rank"]: r["doc"] for r in S.drop_declared(df.fillna("", ["kind"])).collect()}
    assert got == {1: "second", 4: None, 5: None}


def test_knn_in_blocks_equals_one_block(spark):
    rnd = random.Random(3)
    v = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100, None), (101, []), (102, [0.0] * 8), (103, [1.0])]
    df = spark.createDataFrame(v, "id bigint, v array<double>")
    q = df.where("id % 10 = 0").withColumnRenamed("id", "q_id")
    a = sorted(map(tuple, S.knn(df, q, 5, drop_self=True).collect()))
    b = sorted(map(tuple, S.knn(df, q, 5, drop_self=True, max_matrix=16).collect()))
    assert a == b
    assert len(a) == 30
    assert S.knn(df.limit(0), q, 5).count() == 0
    assert S.knn(df, q.limit(0), 5).count() == 0


def test_threshold_search_gives_every_link(spark):
    rnd = random.Random(4)
    v = [(i, [1.0, rnd.gauss(0, 0.1), rnd.gauss(0, 0.1)]) for i in range(60)] + [(100, [-1.0, 0.0, 0.0]), (101, None), (102, [0.0] * 3)]
    df = spark.createDataFrame(v, "id bigint, v array<double>").repartition(3)
    q = df.where("id % 10 = 0 and id < 60").withColumnRenamed("id", "q_id")
    for size in (4_000_000, 6):
        got = [(r.q_id, r.id) for r in S.knn(df, q, None, min_score=0.3, drop_self=True, max_matrix=size).collect()]
        assert sorted(got) == sorted((a, b) for a in range(0, 60, 10) for b in range(60) if a != b)


def test_hybrid_and_prompts_use_the_whole_text(spark, tmp_path):
    from codeloom.plans import reports, retrieval

    texts = {100: "word " * 40 + "needle", 101: "needle", 102: "x" * 70 + "<&>"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, 2.0]) for i in texts], "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.id: r.sparse_rank for r in retrieval.hybrid_rrf(spark, str(tmp_path)).collect()}
    assert found[101] is not None
    assert found[102] is None
    modes = {(r.mode, r.id) for r in retrieval.hybrid_modes(spark, str(tmp_path)).collect()}
    assert ("sparse", 101) in modes
    assert {r.doc_id: r.escaped for r in reports.prompt_windows(spark, str(tmp_path)).collect()}[102] == "x" * 70 + "&lt;&amp;&gt;"
