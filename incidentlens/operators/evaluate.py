"""Evaluation: what a plain text search would have reported, and how well two groupings agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ERROR_WORDS = r"(?i)\b(?:error|fatal|exception|fail(?:ed|ure)?|critical)\b"
CITED = 5


def grep_baseline(events: DataFrame, templated: bool = True, words: str = ERROR_WORDS) -> DataFrame:
    """One row (none if nothing matches): matching lines, groups, the largest group, its first template and cited ids.

    Groups are templates, or messages with digit runs replaced; a tie goes to the group that appears first.
    """
    text = F.coalesce("raw", "message")
    body = F.coalesce("message", "raw")
    key = F.col("template_id").cast("string") if templated else F.regexp_replace(body, r"\d+", "#")
    rows = events.where(text.rlike(words)).withColumn("key", key)
    total = rows.agg(F.count("*").alias("matching"))
    groups = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("top_count"), F.min("id").alias("first_id"), F.min_by("template_id", "id").alias("template_id"))
    n = groups.agg(F.count("*").alias("n_groups"))
    top = groups.orderBy(F.desc("top_count"), "first_id").limit(1)
    order = Window.partitionBy("key").orderBy("id")
    cited = rows.join(F.broadcast(top.select("key")), "key", "left_semi").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= CITED)
    cited = cited.agg(F.sort_array(F.collect_list("id")).alias("cited"))  # CITED rows
    return top.join(total, F.lit(True)).join(n, F.lit(True)).join(cited, F.lit(True)).select("matching", "n_groups", "top_count", "template_id", F.concat_ws(",", F.transform("cited", lambda x: x.cast("string"))).alias("cited"))


def grouping_accuracy(lines: DataFrame, parsed: str = "parsed", truth: str = "truth") -> DataFrame:
    """One row: the share of lines whose parsed group is exactly a true group."""
    both = lines.groupBy(parsed, truth).agg(F.count("*").alias("n"))
    by = lambda c: both.groupBy(c).agg(F.sum("n").alias(f"n_{c}"))
    joined = both.join(by(parsed), parsed).join(by(truth), truth)
    exact = F.sum(F.when((F.col("n") == F.col(f"n_{parsed}")) & (F.col("n") == F.col(f"n_{truth}")), F.col("n")).otherwise(0))
    return joined.agg(F.coalesce(exact / F.sum("n"), F.lit(0.0)).alias("grouping_accuracy"))
