"""Cutting lineage and joining small lookup tables in a way that survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup side of at most this many rows may be broadcast; beyond it the join is salted.
BROADCAST_ROWS = 20_000
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or with a local master, where that is unset, a local one."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, kind: str = "tables") -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quillon-{kind}/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once as a table in the shared folder and read from there."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def lookup_join(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", salt_on: str | None = None) -> DataFrame:
    """``rows`` joined to a lookup that is unique on ``on``.

    The lookup is broadcast only when a count bounded by ``BROADCAST_ROWS`` proves it small;
    a larger one is replicated over ``SALTS`` salts so that a hot key is spread over that many tasks.
    ``salt_on`` names the column whose hash picks a row's salt, else all columns do; a row keeps its salt
    when a task runs again.
    """
    if lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lookup), on, how)
    salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*([salt_on] if salt_on else rows.columns)), F.lit(SALTS)).cast("int"))
    return spread.join(salted, [*on, "_salt"], how).drop("_salt")


#: A table of less than this per core is read by too few tasks for work that is heavy for its bytes.
BYTES_PER_CORE = 1 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over twice as many tasks as there are cores, if its size would give fewer than one a core.

    Only the layout changes. Large tables stay as they are read; their size is the optimizer's estimate.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores, key) if size < cores * BYTES_PER_CORE else df
