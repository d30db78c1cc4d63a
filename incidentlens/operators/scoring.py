"""Anomaly scores of templates, without any model, and the cut that makes the signal set."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens.functions import severity as S
from incidentlens.operators.ranks import numbered

# The weights of the score and the scale of burstiness.
WEIGHTS = {"severity": 0.5, "burstiness": 0.3, "rarity": 0.2}
BURST_SCALE = 10.0


def ln_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x >= 1 by Stirling's series, shifted up by 8 (error below 1e-11)."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    out = (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series
    for i in range(8):
        out = out - F.log(x + i)
    return out


def burstiness(peak: Column, total: Column, buckets: Column) -> Column:
    """How unlikely a template's fullest bucket is if its events came evenly (Poisson), mapped to 0..1."""
    mean = total / buckets
    surprise = F.greatest(F.lit(0.0), -(peak * F.log(mean) - mean - ln_gamma(peak + 1)))
    flat = (total <= 1) | (peak <= 0) | (buckets <= 1) | (peak <= mean)
    return F.when(flat, F.lit(0.0)).otherwise(surprise / (surprise + BURST_SCALE))


def rarity(count: Column, most: Column) -> Column:
    return F.when((count <= 0) | (most <= 1), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.log1p(count) / F.log1p(most)))


def severity_source(stats: DataFrame, informative: bool) -> DataFrame:
    """One row: field, lexical (if the texts' severities differ) or none."""
    if informative:
        return stats.limit(0).agg(F.lit("field").alias("severity_source"))
    differ = F.countDistinct(S.lexical(F.col("pattern"))) > 1
    return stats.agg(F.when(differ, "lexical").otherwise("none").alias("severity_source"))


def score(stats: DataFrame, buckets: DataFrame, informative: bool = True, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """template_id, score, severity, burstiness, rarity.

    stats: template_id, pattern, occurrence_count, max_severity_rank, max_per_bucket; buckets: one row, n_buckets.
    Where no severity can be had its weight goes to the others.  Scalars join as one-row tables.
    """
    if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must not be negative and must sum to a positive value")
    most = F.broadcast(stats.agg(F.max("occurrence_count").alias("_most")))
    facts = stats.join(most, F.lit(True)).join(F.broadcast(buckets), F.lit(True)).join(F.broadcast(severity_source(stats, informative)), F.lit(True))
    level = F.when(F.col("severity_source") == "lexical", S.lexical(F.col("pattern"))).otherwise(S.weight_of_rank(F.col("max_severity_rank")))
    w = F.when(F.col("severity_source") == "none", F.lit(0.0)).otherwise(F.lit(float(weights["severity"])))
    parts = facts.select(
        "template_id", w.alias("w"), level.cast("double").alias("s"), burstiness(F.col("max_per_bucket"), F.col("occurrence_count"), F.col("n_buckets")).alias("b"),
        rarity(F.col("occurrence_count"), F.col("_most")).alias("r"),
    )
    other = float(weights["burstiness"] + weights["rarity"])
    total = (F.col("w") * F.col("s") + weights["burstiness"] * F.col("b") + weights["rarity"] * F.col("r")) / (F.col("w") + other)
    return parts.select("template_id", F.round(total, 6).alias("score"), F.round("s", 6).alias("severity"), F.round("b", 6).alias("burstiness"), F.round("r", 6).alias("rarity"))


def ranked(scores: DataFrame) -> DataFrame:
    """With ``rank``: best score first, ties by id; numbered by ranges of the score."""
    return numbered(scores, [F.desc("score"), F.col("template_id")], "rank")


def signal_set(scores: DataFrame, least: int = 3, most: int = 15) -> DataFrame:
    """The ranked templates above the largest drop between neighbours, at least ``least`` and at most ``most``."""
    if not 0 < least <= most:
        raise ValueError("need 0 < least <= most")
    top = scores.orderBy(F.desc("score"), "template_id").limit(most + 1)  # a top-k; what follows is one row of it
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "template_id", "score"))).alias("t"))
    # The drop behind place p, for the places that may be the last: the largest wins, of equal ones the first.
    drops = F.transform(
        F.filter(F.sequence(F.lit(least), F.lit(most - 1)) if least < most else F.array().cast("array<int>"), lambda p: p < F.size("t")),
        lambda p: F.struct((F.get("t", p - 1)["score"] - F.get("t", p)["score"]).alias("drop"), (-p).alias("first")),
    )
    cut = F.coalesce(-F.array_max(drops)["first"], F.least(F.size("t"), F.lit(most)))
    placed = listed.select(F.posexplode(F.slice("t", F.lit(1), cut)).alias("at", "e"))
    return placed.select(F.col("e.template_id").alias("template_id"), F.col("e.score").alias("score"), (F.col("at") + 1).alias("rank"))


def needle_position(scores: DataFrame, templates: DataFrame) -> DataFrame:
    """Rank of the template with the lowest id among those of the worst severity: one more than the templates before it."""
    worst = templates.orderBy(F.desc("max_severity_rank"), "template_id").limit(1).select("template_id")
    own = F.broadcast(scores.join(F.broadcast(worst), "template_id").select(F.col("template_id").alias("_id"), F.col("score").alias("_score")))  # one row
    before = (F.col("score") > F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("template_id") < F.col("_id")))
    return scores.join(own, F.lit(True)).groupBy(F.col("_id").alias("template_id")).agg((F.count_if(before) + 1).cast("int").alias("rank"))


def with_scores(templates: DataFrame, scores: DataFrame) -> DataFrame:
    """Templates with ``anomaly_score`` (0 where none)."""
    return templates.join(scores.select("template_id", F.col("score").alias("anomaly_score")), "template_id", "left").fillna(0.0, ["anomaly_score"])
