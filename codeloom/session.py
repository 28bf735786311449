"""Session defaults and the scratch tables that cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
}


def build(master: str = "local[8]", app: str = "codeloom", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; on a cluster use the session given."""
    b = SparkSession.builder.master(master).appName(app).config("spark.ui.enabled", "false")
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, else the checkpoint folder set on the context.

    Only a local session, which has one machine, gets a temporary folder where neither is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or spark.conf.get("codeloom.scratch.dir", None)
    if not base:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-codeloom-")
        spark.conf.set("codeloom.scratch.dir", base)
    return base.rstrip("/")


class Scratch:
    """Tables of one run in the shared folder.

    Iterative operators write each step here and read it back: the lineage is cut and the rows survive the loss of any
    executor. A step that is no longer read is deleted at once; what a returned DataFrame still reads stays until
    ``Scratch.clear``, which deletes all that a session has left.
    """

    _left: dict[str, list[str]] = {}

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._left.setdefault(spark.sparkContext.applicationId, []).append(self.base)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path := f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for n in names:
            _delete(self.spark, f"{self.base}/{n}")

    @classmethod
    def clear(cls, spark: SparkSession) -> None:
        for base in cls._left.pop(spark.sparkContext.applicationId, []):
            _delete(spark, base)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
