"""Live counterparts of the ingest's aggregates, over Structured Streaming (an extension beyond the batch engine).

State is bounded by the watermark: late rows beyond it are dropped by Spark, and closed windows leave the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.functions import severity as S
from incidentlens.sources import readers


def json_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Records of JSON Lines files as they arrive in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).format("text").load(folder)
    rows = lines.select(F.lit(None).cast("string").alias("source_file"), F.lit(0).cast("long").alias("line_no"), F.col("value").alias("line"))
    return readers.json_lines(rows).where("status = 'ok'")


def rates(records: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events, bad events and the worst rank per window and source."""
    rank = S.rank(F.col("severity"))
    return records.withWatermark("ts", late).groupBy(F.window("ts", window), "source").agg(
        F.count("*").alias("events"), F.count_if(rank >= S.LEVELS.index("ERROR")).alias("bad"), F.max(rank).alias("max_severity_rank")
    ).select(F.col("window.start").alias("window_start"), "source", "events", "bad", "max_severity_rank")


def sessions(records: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of bad events per source: runs without a pause longer than ``gap``."""
    bad = records.where(S.rank(F.col("severity")) >= S.LEVELS.index("ERROR"))
    return bad.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "source").agg(F.count("*").alias("events")).select(
        F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("last_ts"), "source", "events"
    )


def to_table(df: DataFrame, folder: str, checkpoint: str):
    """Appends closed windows to a Parquet folder, exactly once through the checkpoint; processes what is there and stops."""
    return df.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
