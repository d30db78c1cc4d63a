"""Sources whose clock differs from that of most events, as aggregates over sources and shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens.operators import aggregates as A
from incidentlens.operators.ranks import written


def busiest(rows: DataFrame) -> DataFrame:
    """One row, ``source``: the one with most events, of equal ones the last by name."""
    return rows.agg(F.max_by("source", F.struct("events", "source")).alias("source")).where("source is not null")


def _convincing(least_minutes: int, least_gain: float) -> Column:
    return (F.abs("shift") >= least_minutes) & (F.col("overlap") - F.col("unshifted") >= least_gain)


def clock_offsets(
    events: DataFrame, *, least_events: int, least_minutes: int, least_gain: float, step: int = 15, hours: int = 14,
) -> DataFrame:
    """source, shift (minutes), overlap, unshifted, anchor: a row per source whose clock is off.

    Every source with ``least_events`` gets the shift under which its active slots lie best on the busiest source's.  Sources of
    one shift share a clock; the clock with most events is taken as right, since the busiest source may be the wrong one.  The
    others are measured again, against the busiest source of the right clock, their ``anchor``.
    """
    sizes = A.source_activity(events).where(F.col("events") >= least_events).select("source", "events")
    minutes = written(A.source_minutes(events).join(sizes.select("source"), "source"))
    convincing = _convincing(least_minutes, least_gain)
    measured = A.best_shift(A.shift_overlaps(minutes, busiest(sizes), step, hours)).where(convincing).select("source", "shift")
    clocks = written(sizes.join(measured, "source", "left").select("source", "events", F.coalesce("shift", F.lit(0)).alias("clock")))  # a row per source
    totals = clocks.groupBy("clock").agg(F.sum("events").alias("events"))
    right = totals.agg(F.max_by("clock", F.struct(F.col("events"), -F.abs("clock"), F.col("clock"))).alias("right"))  # one row
    sided = clocks.join(F.broadcast(right), F.lit(True))
    anchor = busiest(sided.where("clock = right"))
    again = A.best_shift(A.shift_overlaps(minutes, anchor, step, hours)).where(convincing)
    wrong = sided.where("clock != right").select("source")
    return again.join(wrong, "source", "left_semi").join(F.broadcast(anchor.withColumnRenamed("source", "anchor")), F.lit(True))
