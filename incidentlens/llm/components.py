"""Connected components over an edge table, without collecting anything.

Alternating large-star / small-star contraction.  Each half-step is an
aggregate (which combines before its shuffle) and an equi join (which Spark can
split where a node is hot); neighbour lists are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm.common import drop, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("hi", "lo").union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
    return (
        both.where("lo > hi").join(least, "hi")
        .select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1000003), F.sum(F.xxhash64("lo", "hi") % 998244353)).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> tuple[DataFrame, str]:
    """(table (node, root) of every node that has an edge except the roots, its scratch path).

    The root is the smallest node of a component.  No edges: no rows.  Self loops and nulls are ignored.
    """
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi != lo").distinct()
    now, path = materialize(now, "edges")
    spark, state = now.sparkSession, _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        large, large_path = materialize(_large_star(now), "large")
        drop(spark, path)
        now, path = materialize(_small_star(large), "small")
        drop(spark, large_path)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")), path
