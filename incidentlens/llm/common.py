"""Plumbing shared by the corpus operators: inputs, scratch tables, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are bounded by rows and by bytes, so a run of very long texts cannot fill a worker.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20

_local: list[str] = []
_written: set[str] = set()


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that Python workers receive; touches no partitioning setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # an older Spark has only the row bound
        pass
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the shared folder of the cluster, removed when the driver exits.

    Only a session on one machine (tests) may do without a shared folder: its scratch is then local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="scratch-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        return _local[0]
    root = f"{named.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    if root not in _written:
        _written.add(root)
        atexit.register(_remove_at_exit, spark, root)
    return root


def _remove_at_exit(spark: SparkSession, root: str) -> None:
    """What results still read can't go earlier; a session that has ended before the driver leaves its folder."""
    if spark.sparkContext._jsc is not None:
        drop(spark, root)


def materialize(df: DataFrame, label: str, *, merge: bool = False) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it back: lineage ends in replicated files.

    ``merge`` has Spark even out the partitions first, so that many tasks with short results don't leave as many files.
    """
    df = df.hint("rebalance") if merge else df
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that later ones have replaced."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def small_enough(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> bool:
    """Whether ``df`` has at most ``limit`` bytes, by counting its rows."""
    return df.limit(limit // row_bytes + 1).count() * row_bytes <= limit


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """A broadcast hint only where a count proves the size; else Spark shuffles both sides."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df
