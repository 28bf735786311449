"""Incremental indexing, merging and versions of datasets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: list[str], hash_col: str) -> DataFrame:
    """key, status: new, changed, unchanged or deleted, from two states by a full outer join. A null hash differs from any other but null."""
    o = old.select(*key, F.col(hash_col).alias("old_hash"), F.lit(True).alias("in_old")).dropDuplicates(key)
    n = new.select(*key, F.col(hash_col).alias("new_hash"), F.lit(True).alias("in_new")).dropDuplicates(key)
    status = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "deleted").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(*key, status.alias("status"))


def embedding_needs(status: DataFrame, has_vector: DataFrame, key: list[str], wanted: bool = True) -> DataFrame:
    """key, status, needs: a new row if wanted, a changed one if wanted or had, an unchanged one if wanted and not had."""
    s = status.join(has_vector.select(*key).distinct().withColumn("had", F.lit(True)), key, "left").withColumn("had", F.coalesce("had", F.lit(False)))
    w = F.lit(wanted)
    needs = F.when(F.col("status") == "new", w).when(F.col("status") == "changed", w | F.col("had")).when(F.col("status") == "unchanged", w & ~F.col("had")).otherwise(False)
    return s.withColumn("needs", needs)


def merge_first_wins(sources: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, from the source that comes first. ``order`` ranks the sources."""
    w = Window.partitionBy(*key).orderBy(order)
    return sources.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_collisions(sources: DataFrame, key: list[str], order: str) -> DataFrame:
    """order, n_rows, n_collisions: per source, the rows that an earlier source already had."""
    w = Window.partitionBy(*key).orderBy(order)
    s = sources.withColumn("_n", F.row_number().over(w))
    return s.groupBy(order).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_n") > 1).alias("n_collisions"))


def keep_newest(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The n newest rows of each group, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def vector_state(docs: DataFrame, vectors: DataFrame, by: str, doc_id: str, vec_id: str) -> DataFrame:
    """by, n_docs, n_vectors, state: none, partial or full."""
    v = vectors.select(F.col(vec_id).alias("_v")).distinct()
    g = docs.join(v, F.col(doc_id) == F.col("_v"), "left").groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), F.count("_v").alias("n_vectors"))
    return g.withColumn("state", F.when(F.col("n_vectors") == 0, "none").when(F.col("n_vectors") < F.col("n_docs"), "partial").otherwise("full"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose key isn't in new, and the new rows."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


class Generations:
    """Versions of a dataset as directories gen=N beside a pointer that is swapped by one rename.

    Readers follow the pointer; a new version is written apart and becomes visible as a whole or not at all. One writer at a time.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self.fs.exists(self._path(self.base)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.base))]
        return sorted(int(n[4:]) for n in names if n.startswith("gen=") and n[4:].isdigit())

    def _pointers(self) -> list[int]:
        if not self.fs.exists(self._path(self.base)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.base))]
        return sorted(int(n[8:]) for n in names if n.startswith("CURRENT=") and n[8:].isdigit())

    def current(self) -> int | None:
        p = self._pointers()
        return p[-1] if p else None

    def write(self, df: DataFrame, swap: bool = True) -> int:
        n = max([0, *self.numbers()]) + 1
        df.write.mode("errorifexists").parquet(f"{self.base}/gen={n}")
        if swap:
            self.swap(n)
        return n

    def swap(self, n: int, keep_previous: int = 1) -> None:
        """Point at version n and delete all but it and the newest ``keep_previous`` older ones."""
        if n not in self.numbers():
            raise ValueError(f"no generation {n}")
        for p in self._pointers():
            if p > n:  # a step back
                self.fs.delete(self._path(f"{self.base}/CURRENT={p}"), True)
        self.fs.mkdirs(self._path(f"{self.base}/CURRENT={n}"))
        for p in self._pointers():
            if p < n:
                self.fs.delete(self._path(f"{self.base}/CURRENT={p}"), True)
        older = [x for x in self.numbers() if x < n]
        for x in older[: max(0, len(older) - keep_previous)]:
            self.fs.delete(self._path(f"{self.base}/gen={x}"), True)

    def read(self, n: int | None = None) -> DataFrame:
        n = self.current() if n is None else n
        if n is None:
            raise ValueError("no current generation")
        return self.spark.read.parquet(f"{self.base}/gen={n}")


def export_rows(df: DataFrame) -> DataFrame:
    """One JSON line per row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def export(df: DataFrame, path: str, name: str) -> None:
    """Gzip JSON lines and, beside them, a manifest with name, count and schema."""
    export_rows(df).write.mode("errorifexists").option("compression", "gzip").text(f"{path}/rows")
    n = df.sparkSession.read.text(f"{path}/rows").count()
    manifest = json.dumps({"name": name, "count": n, "schema": df.schema.jsonValue()})
    df.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")


def import_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an export. A malformed line or another count than the manifest's is an error before anything is published."""
    from pyspark.sql.types import StructType

    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    schema = StructType.fromJson(manifest["schema"])
    lines = spark.read.text(f"{path}/rows")
    if (n := lines.count()) != manifest["count"]:
        raise ValueError(f"{n} rows, the manifest says {manifest['count']}")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def merge_fields(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keyed rows of both; a field of new counts unless it is null, an empty string clears it."""
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    pick = lambda c: F.when(F.col(f"_n_{c}").cast("string") == "", None).otherwise(F.coalesce(F.col(f"_n_{c}"), F.col(c))).alias(c)
    return old.select(*key, *columns).join(n, key, "full").select(*key, *[pick(c) for c in columns])


def index_run(old: DataFrame, new: DataFrame, key: str, hash_col: str, generations: Generations | None = None) -> tuple[DataFrame, DataFrame]:
    """The next state of an index and its counters (status, n): unchanged rows stay, new and changed ones are taken, stale ones go in the same plan.

    Of rows with one id the last by hash counts. With ``generations`` the state is published as the next version.
    """
    new = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), F.coalesce(hash_col, F.lit(""))).alias("_r")).select(key, "_r.*")
    status = diff(old, new, [key], hash_col)
    taken = new.join(status.where("status in ('new', 'changed')").select(key), key, "left_semi")
    state = old.join(status.where("status = 'unchanged'").select(key), key, "left_semi").unionByName(taken, allowMissingColumns=True)
    if generations is not None:
        state = generations.read(generations.write(state))
    return state, status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def migrate_ids(chunks: DataFrame, new_id: Column, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks under new ids with old_id beside them, and edges (caller_id, callee_id) re-keyed; edges with an end that is gone are dropped. Parts keep their id."""
    moved = chunks.withColumn("old_id", F.col("id")).withColumn("id", F.when(F.col("kind") == "method_part", F.col("id")).otherwise(new_id))
    ids = moved.select("old_id", "id").distinct()
    e = edges
    for end in ("caller_id", "callee_id"):
        e = e.join(ids.select(F.col("old_id").alias(end), F.col("id").alias("_id")), end).drop(end).withColumnRenamed("_id", end)
    return moved, e


def rename_collection(tables: dict[str, DataFrame], column: dict[str, str], old: str, new: str | None) -> dict[str, DataFrame]:
    """Every table with a collection renamed, or deleted if ``new`` is null. Renaming onto an existing name is an error."""
    if new is not None and any(not t.where(F.col(column[n]) == new).isEmpty() for n, t in tables.items()):
        raise ValueError(f"{new} exists")
    if new is None:
        return {n: t.where(~F.col(column[n]).eqNullSafe(F.lit(old))) for n, t in tables.items()}
    return {n: t.withColumn(column[n], F.when(F.col(column[n]) == old, new).otherwise(F.col(column[n]))) for n, t in tables.items()}


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object per line, other than ASCII kept as it is; to a new folder, or behind what is there."""
    export_rows(df).write.mode("append" if append else "errorifexists").text(path)
