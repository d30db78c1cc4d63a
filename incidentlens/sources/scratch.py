"""A place for files that one run writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_cleared: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A new folder's path below the application's folder in the shared one that the session names; local only where the session is.

    The application's folder goes when the driver exits.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        root = f"{named.rstrip('/')}/files-{spark.sparkContext.applicationId}"
        if root not in _cleared:
            _cleared.add(root)
            atexit.register(_remove, spark, root)
        return f"{root}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="files-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"{made}/data"


def _remove(spark: SparkSession, root: str) -> None:
    """A session that has ended before the driver leaves its folder."""
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
