from collections import Counter

from pyspark.sql import functions as F

from codeloom.operators import skew

SCHEMA = "id bigint, indexed_at timestamp, calls array<struct<id:bigint,name:string>>, called_by array<struct<id:bigint,name:string>>, key_id string, side int, n string"


def rows(spark, data):
    out = []
    for i, t, calls, by in data:
        wrap = lambda xs: None if xs is None else [None if x == "null" else (x, "n") for x in xs]
        out.append((i, t, wrap(calls), wrap(by), "clash", 7, None))
    return spark.createDataFrame(out, SCHEMA)


def ts(day):
    import datetime

    return datetime.datetime(2024, 1, day)


def test_counts_only_current_rows_and_handles_nulls_and_ties(spark):
    df = rows(spark, [
        (1, ts(2), [5, 5, None, "null", 6], None), (1, ts(1), [9], [9]), (1, ts(2), [5, 5, None, "null", 6], None),
        (2, None, [5], []), (None, ts(3), [5], [5]), (3, ts(1), None, [5]),
    ])
    got = {(r.side, r.key_id): (r.n_references, r.n_chunks) for r in skew.reference_counts(df).collect()}
    assert got == {("calls", 5): (3, 2), ("calls", 6): (1, 1), ("called_by", 5): (1, 1)}


def test_empty(spark):
    assert skew.reference_counts(rows(spark, [])).count() == 0
    assert skew.dominant_keys(skew.reference_counts(rows(spark, []))).count() == 0


def test_heavy_key_is_salted_and_result_is_exact(spark):
    data = [(i, ts(1), [1 if i % 3 else i, i % 7 + 100], []) for i in range(1, 900)]
    want = Counter(x for _, _, c, _ in data for x in c)
    df = rows(spark, data)
    got = {r.key_id: r.n_references for r in skew.reference_counts(df).collect()}
    assert got == dict(want)
    flat = df.select("id", F.explode("calls.id").alias("key_id"))
    heavy = skew.heavy_keys(flat, "key_id")
    assert 1 in heavy
    assert len(heavy) <= 1 / skew.HEAVY_SHARE + 1
    assert {r.key_id for r in skew.dominant_keys(skew.reference_counts(df)).collect()} == {k for k, n in want.items() if n >= 0.03 * sum(want.values())}
