"""Aggregates over events and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.functions import severity as S
from incidentlens.functions import texts, times
from incidentlens.operators.reads import UNKNOWN

CHRONIC_SHARE = 0.9
# What an identifier looks like in a template, what marks a failure, and what continues an entry.
ID_TOKEN = r"(?i)^(?:.*[^0-9a-f])?(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{16,}|\d{7,})"
FAILURE = r"(?i)\b(error|errors|fail|failed|failure|exception|refused|denied|timeout|timed out|fatal|cannot|unable|abort|aborted|panic)\b"
CONTINUATION = (
    r"^(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?Z?\s+)?"
    r"(?:\s+at\s+\S|at\s+[\w$]+(?:\.[\w$<>]+)+\(|\s*Caused by:\s|\s*\.\.\. \d+ (?:more|common frames omitted)"
    r"|\s*File \"[^\"]+\", line \d+|\s*Traceback \(most recent call last\)|goroutine \d+ \[|\s+/\S+\.go:\d+)"
)


def burst_stats(events: DataFrame, templates: DataFrame, minutes: int = 1) -> DataFrame:
    """Per template: its fullest bucket and the buckets it is in; 0 for templates without events."""
    per = events.groupBy("template_id", times.bucket(F.col("ts"), minutes).alias("b")).agg(F.count("*").alias("n"))
    per = per.groupBy("template_id").agg(F.max("n").alias("max_per_bucket"), F.count("*").alias("buckets"))
    joined = templates.select("template_id", "occurrence_count", "max_severity_rank").join(per, "template_id", "left")
    return joined.fillna(0, ["max_per_bucket", "buckets"])


def bucket_count(events: DataFrame, minutes: int = 1) -> DataFrame:
    return events.agg(F.countDistinct(times.bucket(F.col("ts"), minutes)).alias("n_buckets"))


def severity_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("severity").agg(F.count("*").alias("n"))


def source_activity(events: DataFrame, least: str = "ERROR") -> DataFrame:
    """Per source: events, events at or over a level, and when those first and last came."""
    if least.upper() not in S.LEVELS:
        return events.select(F.col("source"), F.lit(0).alias("events"), F.lit(0).alias("bad"), F.col("ts").alias("first_bad"), F.col("ts").alias("last_bad")).limit(0)
    bad = F.col("severity").isin(*S.LEVELS[S.LEVELS.index(least.upper()) :])
    return events.groupBy(F.coalesce("source", F.lit(UNKNOWN)).alias("source")).agg(
        F.count("*").alias("events"), F.count_if(bad).alias("bad"), F.min(F.when(bad, F.col("ts"))).alias("first_bad"), F.max(F.when(bad, F.col("ts"))).alias("last_bad")
    )


def template_window(events: DataFrame, ids: list[int]) -> DataFrame:
    return events.where(F.col("template_id").isin(list(ids))).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def time_bounds(events: DataFrame) -> DataFrame:
    return events.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def source_minutes(events: DataFrame) -> DataFrame:
    return events.select(F.coalesce("source", F.lit(UNKNOWN)).alias("source"), times.epoch_minute(F.col("ts")).alias("minute")).distinct()


def template_summary(events: DataFrame) -> DataFrame:
    """Templates from events: counts, span, severities, worst rank; the pattern is that of the latest event."""
    ranked = events.withColumn("_rank", S.rank(F.col("severity")))
    levels = [F.count_if(F.col("severity") == name).alias(f"n_{name.lower()}") for name in S.LEVELS]
    return ranked.groupBy("template_id").agg(
        F.max_by("pattern", F.struct("ts", "id")).alias("pattern"), F.count("*").alias("occurrence_count"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"), F.max("_rank").alias("max_severity_rank"), F.min("_rank").alias("min_severity_rank"), *levels,
    )


def severity_mix(templates: DataFrame) -> DataFrame:
    """``templates`` with a map of the severities that occur."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"n_{n.lower()}").alias("value")) for n in S.LEVELS])
    return templates.withColumn("severity_mix", F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0)))


def run_stats(templates: DataFrame) -> DataFrame:
    """Events, templates, reduction factor, compression ratio and the largest template's share."""
    total, n = F.sum("occurrence_count"), F.count("*")
    return templates.agg(
        F.coalesce(total, F.lit(0)).alias("events"), n.alias("templates"), (total / n).alias("reduction_factor"), (n / total).alias("ratio"),
        (F.max("occurrence_count") / total).alias("dominant_share"),
    )


def chronic(templates: DataFrame, events: DataFrame, share: float = CHRONIC_SHARE) -> DataFrame:
    """template_id of templates active over ``share`` of the log's span; none of a log without a span."""
    span = F.broadcast(events.agg(times.minutes_between(F.min("ts"), F.max("ts")).alias("_span")))  # one row
    active = times.minutes_between(F.col("first_seen"), F.col("last_seen"))
    return templates.join(span, F.col("_span") > 0).where(active >= F.col("_span") * share).select("template_id")


def over_merged(templates: DataFrame, span: int = 3) -> DataFrame:
    """Templates whose severities lie ``span`` levels apart or more, both ends counted."""
    wide = (F.col("max_severity_rank") - F.col("min_severity_rank") + 1).alias("span")
    return templates.select("template_id", wide).where((F.col("span") >= span) & (F.col("span") > 1))


def orphans(events: DataFrame, templates: DataFrame) -> DataFrame:
    return events.join(templates.select("template_id"), "template_id", "left_anti").agg(F.count("*").alias("n"))


def split_templates(templates: DataFrame) -> DataFrame:
    """One row: events in templates that share their last four tokens (two of them literal) with another, and their share."""
    token = texts.tokens(F.col("pattern"))
    tail = F.slice(token, F.greatest(F.size(token) - 3, F.lit(1)), F.lit(4))
    rows = templates.select("occurrence_count", tail.alias("tail")).where(F.size(F.filter("tail", lambda t: t != "<*>")) >= 2)
    groups = rows.groupBy("tail").agg(F.count("*").alias("n"), F.sum("occurrence_count").alias("events")).where("n > 1")
    return _share(groups, templates)


def literal_ids(templates: DataFrame) -> DataFrame:
    """One row: events in templates with an identifier among their tokens, and their share."""
    carrying = F.exists(texts.tokens(F.col("pattern")), lambda t: t.rlike(ID_TOKEN))
    return _share(templates.where(carrying).select(F.col("occurrence_count").alias("events")), templates)


def _share(part: DataFrame, templates: DataFrame) -> DataFrame:
    some = part.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"))
    total = F.broadcast(templates.agg(F.sum("occurrence_count").alias("_total")))  # one row
    return some.join(total, F.lit(True)).select("events", F.coalesce(F.col("events") / F.col("_total"), F.lit(0.0)).alias("share"))


def text_scan(events: DataFrame, templates: DataFrame, stride: int = 1) -> DataFrame:
    """One row: failure lines, those hidden in templates that don't show it, events read, continuation lines."""
    from incidentlens.operators.reads import regex_counts

    counts = regex_counts(events, {"failure": FAILURE, "continuation": CONTINUATION}, stride)
    shown = counts.join(templates.select("template_id", F.col("pattern").rlike(FAILURE).alias("shows")), "template_id", "left")
    hidden = (F.col("failure") > 0) & (F.col("failure") < F.col("events")) & ~F.coalesce("shows", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return shown.agg(
        zero(F.sum("failure")).alias("failure_lines"), zero(F.sum(F.when(hidden, F.col("failure")))).alias("hidden"),
        zero(F.sum("events")).alias("examined"), zero(F.sum("continuation")).alias("continuation"),
    )


def zone_notation(lines: DataFrame) -> DataFrame:
    """Per source: how its ISO timestamps write their zone (lines: source, text)."""
    at = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?"
    zone = F.regexp_extract("text", f"{at}(Z|[+-]\\d{{2}}:?\\d{{2}})?", 1)
    name = (
        F.when(zone == "", "naive").when((zone == "Z") | F.replace(zone, F.lit(":"), F.lit("")).isin("+0000", "-0000"), "utc")
        .when(zone.contains(":"), zone).otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)))
    )
    return lines.where(F.col("text").rlike(at)).groupBy("source", name.alias("zone")).agg(F.count("*").alias("n"))


def shift_overlaps(minutes: DataFrame, reference: str | DataFrame, step: int = 15, hours: int = 14) -> DataFrame:
    """source, shift, overlap: the share of the smaller slot set that a shift of the other source's brings together.

    ``reference`` names the source that the others are laid on, or is one row with its ``source``.  The band join becomes an equi join on the shifted slot.
    """
    slots = minutes.select("source", F.floor(F.col("minute") / step).alias("slot")).distinct()
    sizes = slots.groupBy("source").agg(F.count("*").alias("size"))
    if isinstance(reference, str):
        reference = minutes.sparkSession.createDataFrame([(reference,)], "source string")
    fixed = F.broadcast(reference.select(F.col("source").alias("_fixed")))  # one row
    slots = slots.join(fixed, F.lit(True))
    ref = slots.where("source = _fixed").select("slot")
    reach = hours * 60 // step
    shifted = slots.where("source != _fixed").withColumn("shift", F.explode(F.expr(f"sequence(-{reach}, {reach})"))).select("source", "shift", (F.col("slot") + F.col("shift")).alias("slot"))
    hits = shifted.join(ref, "slot").groupBy("source", "shift").agg(F.count("*").alias("n"))
    own = F.broadcast(sizes.join(fixed, F.col("source") == F.col("_fixed")).select(F.col("size").alias("_ref")))  # one row
    return hits.join(sizes, "source").join(own, F.lit(True)).select("source", (F.col("shift") * step).alias("shift"), (F.col("n") / F.least("size", "_ref")).alias("overlap"))


def best_shift(overlaps: DataFrame) -> DataFrame:
    """Per source: the best shift (ties to no shift, then to the nearest), its overlap and the unshifted one."""
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy(F.desc("overlap"), F.abs("shift"), "shift")
    best = overlaps.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("source", "shift", "overlap")
    still = overlaps.where("shift = 0").select("source", F.col("overlap").alias("unshifted"))
    return best.join(still, "source", "left").fillna(0.0, ["unshifted"])


def token_totals(metrics: DataFrame) -> DataFrame:
    """Per stage: input, its cached part, output and their total (metrics: stage, metric, value)."""
    pick = lambda name: F.coalesce(F.sum(F.when(F.col("metric") == name, F.col("value"))), F.lit(0))
    out = metrics.groupBy("stage").agg(pick("input_tokens").alias("input_tokens"), pick("cached_input_tokens").alias("cached_input_tokens"), pick("output_tokens").alias("output_tokens"))
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def pass_rates(checks: DataFrame) -> DataFrame:
    """Per check: passed and scorable runs (a null result isn't scorable)."""
    return checks.groupBy("check_name").agg(F.count_if(F.col("passed")).alias("passed"), F.count("passed").alias("scorable"))
