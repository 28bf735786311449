import random

from codeloom.streaming import changes as C


def test_moves_and_deletes(spark):
    e = spark.createDataFrame([(1, "upsert", "a", None), (2, "move", "a", "b"), (3, "upsert", "c", None), (4, "delete", "c", None), (5, "move", "b", None), (None, "upsert", "q", None), (6, "upsert", None, None)], "seq bigint, op string, path string, new_path string")
    assert {r.path: (r.op, r.seq) for r in C.fold_changes(e).collect()} == {"a": ("delete", 2), "b": ("delete", 5), "c": ("delete", 4)}


def brute(rows, limit, window):
    log, out = {}, {}
    for c, t, i in sorted(rows):
        q = log.setdefault(c, [])
        q[:] = [x for x in q if t - x <= window]
        out[i] = len(q) < limit
        if out[i]:
            q.append(t)
    return out


def events(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "user bigint, t double, id bigint").withColumn("ts", F.timestamp_seconds("t"))


def test_rate_limit_equals_a_sliding_log(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), float(rnd.randrange(200)), i) for i in range(400)]
    got = C.limit_rate(events(spark, rows), "user", "ts", "id", limit=5, window_s=10).collect()
    assert {r.event_id: r.accepted for r in got} == brute(rows, 5, 10)


def test_rate_limit_as_a_stream_keeps_its_log_between_batches(spark, tmp_path):
    rows = [(1, float(i), i) for i in range(12)]
    src = f"file://{tmp_path}/in"
    events(spark, rows[:6]).coalesce(1).write.parquet(src)
    stream = lambda: C.limit_rate(spark.readStream.schema("user bigint, t double, id bigint, ts timestamp").parquet(src), "user", "ts", "id", limit=2, window_s=4)

    def run():
        q = stream().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(90)
        q.stop()

    run()
    events(spark, rows[6:]).coalesce(1).write.mode("append").parquet(src)
    run()
    got = {r.event_id: r.accepted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == brute(rows, 2, 4)
