"""Numbering rows in an order without sending them through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens.sources.scratch import scratch


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the session's shared folder: later jobs read it instead of computing it again."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """``df`` with ``name``: each row's place in ``order``.

    Rows are dealt by ranges of the order and sorted there; a place is the rows of the ranges before (one count a range) plus
    the place within.  Rows that the order leaves equal have places in any order, but each its own.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # the id's upper bits number the range, the lower ones the row in it
    sizes = {r["p"]: r["n"] for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row per range
    shift, before = [], start
    for p in sorted(sizes):
        shift.append((p, before - (p << 33)))
        before += sizes[p]
    offsets = F.broadcast(df.sparkSession.createDataFrame(shift, "_p long, _shift long"))
    return held.withColumn("_p", part).join(offsets, "_p").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_p", "_shift")
