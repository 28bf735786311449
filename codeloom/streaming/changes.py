"""File changes, telemetry and rate limits as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fold_changes(events: DataFrame) -> DataFrame:
    """path, op, seq: the last state of each path from events (seq, op, path, new_path); deleted paths keep op delete.

    A move is a delete of the old path and an upsert of the new one. Rows without path or seq say nothing.
    """
    e = events.where("path is not null and seq is not null")
    steps = F.when(F.col("op") == "move", F.array(F.struct(F.col("path").alias("path"), F.lit("delete").alias("op")), F.struct(F.col("new_path").alias("path"), F.lit("upsert").alias("op")))).otherwise(F.array(F.struct(F.col("path").alias("path"), F.col("op").alias("op"))))
    s = e.select("seq", F.posexplode(steps).alias("i", "s")).select("seq", "i", "s.path", "s.op").where("path is not null")
    last = s.groupBy("path").agg(F.max(F.struct("seq", "i", "op")).alias("m"))
    return last.select("path", "m.op", "m.seq")


def limit_rate(events: DataFrame, client: str, at: str, event_id: str, limit: int = 300, window_s: float = 10.0) -> DataFrame:
    """client, event_id, accepted: a sliding log of the accepted requests per client; rejected ones are not stored.

    An entry leaves the log once it is older than the window. Works on batches and on streams; the log of a client holds at most ``limit`` times.
    """
    schema = f"{client} bigint, event_id bigint, accepted boolean"

    def step(log: list[float], rows: list[tuple[float, int]]) -> list[tuple[int, bool]]:
        out = []
        for t, i in sorted(rows):
            while log and t - log[0] > window_s:
                log.pop(0)
            ok = len(log) < limit
            if ok:
                log.append(t)
            out.append((i, ok))
        return out

    e = events.where(F.col(client).isNotNull() & F.col(at).isNotNull()).select(F.col(client).cast("bigint").alias(client), F.col(at).cast("timestamp").cast("double").alias("_t"), F.col(event_id).cast("bigint").alias("_id"))

    def stateful(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        rows = [r for b in batches for r in zip(b["_t"], b["_id"])]
        got = step(log, rows)
        state.update((log,))
        yield pd.DataFrame({client: key[0], "event_id": [i for i, _ in got], "accepted": [a for _, a in got]})

    if events.isStreaming:
        return e.groupBy(client).applyInPandasWithState(stateful, schema, "log array<double>", "append", GroupStateTimeout.NoTimeout)

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows arrive sorted by client and time, so a client's log is all that is held, however many requests it made
        who, log = None, []
        for b in batches:
            out = []
            for c, t, i in zip(b[client], b["_t"], b["_id"]):
                if c != who:
                    who, log = c, []
                out += [(c, *x) for x in step(log, [(t, i)])]
            yield pd.DataFrame(out, columns=[client, "event_id", "accepted"])

    return e.repartition(client).sortWithinPartitions(client, "_t", "_id").mapInPandas(ordered, schema)


def windows(events: DataFrame, at: str, by: list[str], value: str, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """window_start, by..., n, total per tumbling window; on a stream give the allowed lateness."""
    e = events.withWatermark(at, late) if late else events
    return e.groupBy(F.window(at, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def watch(spark, source: str, schema: str, apply, checkpoint: str, every: str = "600 seconds"):
    """Run ``apply(batch, id)`` on what is new under a folder, at a fixed interval; started queries resume from the checkpoint."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
