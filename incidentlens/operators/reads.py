"""Bounded reads over the event and template tables: slices, rankings, searches, samples.

Every ordering ends in an id, so results are the same on any number of partitions, and every limit
follows its ordering, which Spark runs as a top-k per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.functions.severity import strip_ansi

UNKNOWN = "unknown"
ORDERINGS = {
    "count": ("occurrence_count", "max_severity_rank"),
    "severity": ("max_severity_rank", "occurrence_count"),
    "recency": ("last_seen", "occurrence_count"),
    "anomaly_score": ("anomaly_score", "occurrence_count"),
}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column: Column) -> Column:
    """A-Z folded, every other letter as it is."""
    return F.translate(column, _UPPER, _LOWER)


def _holds(text: str) -> Column:
    """Whether the message or the raw line holds the text, in any ASCII case."""
    low = text.translate(str.maketrans(_UPPER, _LOWER))
    return F.coalesce(ascii_lower(F.col("message")).contains(low), F.lit(False)) | F.coalesce(ascii_lower(F.col("raw")).contains(low), F.lit(False))


@dataclass(frozen=True)
class Noise:
    """What counts as noise: a large share of events in a template that isn't anomalous."""

    share: float = 0.15
    ceiling: float = 0.35

    def __post_init__(self):
        for name in ("share", "ceiling"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")


def noise_templates(templates: DataFrame, noise: Noise) -> DataFrame:
    """template_id of the templates under the ceiling and at or over the share."""
    total = F.broadcast(templates.agg(F.sum("occurrence_count").alias("_total")))  # one row
    return templates.join(total, F.lit(True)).where((F.col("anomaly_score") < noise.ceiling) & (F.col("occurrence_count") >= F.col("_total") * noise.share)).select("template_id")


def slice_predicate(*, start=None, end=None, source=None, severity=None, template_id=None, trace_id=None) -> Column:
    """Inclusive bounds and equalities that are given; an unknown source is asked for by its name."""
    out = F.lit(True)
    if start is not None:
        out &= F.col("ts") >= F.lit(start).cast("timestamp")
    if end is not None:
        out &= F.col("ts") <= F.lit(end).cast("timestamp")
    if source is not None:
        out &= F.col("source").isNull() if source == UNKNOWN else F.col("source") == source
    for name, value in (("severity", severity), ("template_id", template_id), ("trace_id", trace_id)):
        if value is not None:
            out &= F.col(name) == value
    return out


def slot_predicate(start=None, end=None) -> Column:
    """The slots (times' texts cut to minutes, hours, days or months) that can hold events of a window; rows without a slot are spared."""
    slot, out = F.col("slot"), F.lit(True)
    text = lambda t: F.date_format(F.lit(t).cast("timestamp"), "yyyy-MM-dd HH:mm")
    if start is not None:
        out &= slot >= F.substr(text(start), F.lit(1), F.length(slot))
    if end is not None:
        out &= slot <= text(end)
    return slot.isNull() | out


def matching(events: DataFrame, templates: DataFrame | None = None, noise: Noise | None = None, **where) -> DataFrame:
    """The rows of a slice; noise goes only where no template is asked for by id."""
    rows = events.where(slice_predicate(**where))
    if "slot" in events.columns:
        rows = rows.where(slot_predicate(where.get("start"), where.get("end")))
    if noise is not None and where.get("template_id") is None:
        rows = rows.join(noise_templates(templates, noise), "template_id", "left_anti")
    return rows


def get_slice(events: DataFrame, limit: int = 200, **where) -> DataFrame:
    return matching(events, **where).orderBy("ts", "id").limit(limit)


def slice_count(events: DataFrame, **where) -> DataFrame:
    return matching(events, **where).agg(F.count("*").alias("n"))


def by_ids(events: DataFrame, ids: list[int]) -> DataFrame:
    return events.where(F.col("id").isin(list(ids))).orderBy("ts", "id")


def known_templates(templates: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("template_id").distinct().join(templates.select("template_id"), "template_id", "left_semi")


def unresolved(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Cited ids that no row has."""
    return ids.select(key).distinct().join(table.select(key), key, "left_anti")


def top_templates(templates: DataFrame, limit: int = 10, order_by: str = "count", noise: Noise | None = None) -> DataFrame:
    if order_by not in ORDERINGS:
        raise ValueError(f"unknown ordering {order_by!r}; known: {', '.join(sorted(ORDERINGS))}")
    rows = templates if noise is None else templates.join(noise_templates(templates, noise), "template_id", "left_anti")
    first, second = ORDERINGS[order_by]
    return rows.orderBy(F.desc(first), F.desc(second), "template_id").limit(limit)


def text_search(events: DataFrame, text: str, limit: int = 5000) -> DataFrame:
    """template_id of templates with an event whose message or raw line holds the text, in any ASCII case."""
    return events.where(_holds(text)).select("template_id").distinct().orderBy("template_id").limit(limit)


def matching_events(events: DataFrame, text: str) -> DataFrame:
    """template_id, n: events that hold the text; only if there are none, the same by case without terminal codes.

    Both counts come from one pass over the rows.
    """
    loose, body = _holds(text), F.coalesce("message", "raw")
    exact = F.coalesce(strip_ansi(body).contains(text), F.lit(False))
    counts = events.groupBy("template_id").agg(F.count_if(loose).alias("loose"), F.count_if(exact).alias("exact")).where("loose + exact > 0")
    any_loose = F.broadcast(counts.agg(F.coalesce(F.sum("loose"), F.lit(0)).alias("_all")))  # one row
    n = F.when(F.col("_all") > 0, F.col("loose")).otherwise(F.col("exact"))
    return counts.join(any_loose, F.lit(True)).select("template_id", n.alias("n")).where("n > 0")


def first_per_source(events: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of each source in id order (limited per task before the shuffle)."""
    order = Window.partitionBy(F.coalesce("source", F.lit(UNKNOWN))).orderBy("id")
    return events.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def regex_counts(events: DataFrame, patterns: dict[str, str], stride: int = 1) -> DataFrame:
    """Per template: events, and those whose text matches each named pattern; with a stride, over every stride-th id."""
    rows = events if stride == 1 else events.where(F.col("id") % stride == 0)
    text = F.coalesce("message", "raw")
    return rows.groupBy("template_id").agg(F.count("*").alias("events"), *[F.count_if(text.rlike(p)).alias(name) for name, p in patterns.items()])


def clamp(value: int | None, default: int, most: int, name: str = "limit") -> int:
    """A limit as tools take it: over-large ones are cut, ones below 1 refused."""
    if value is None:
        return default
    if value < 1:
        raise ValueError(f"{name} must be at least 1")
    return min(value, most)
