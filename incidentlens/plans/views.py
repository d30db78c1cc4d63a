"""The views that queries run over, defined once for Spark and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.functions import times
from incidentlens.operators import aggregates, scoring
from incidentlens.operators.ranks import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log records: four services, five message shapes, a hundred templates each."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    k = F.regexp_extract("props", "([0-9]+)", 1)
    code = F.when(kind == "click", 1).when(kind == "error", 2).when(kind == "purchase", 3).when(kind == "signup", 4).otherwise(5)
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("svc-"), F.col("user_id") % 4).alias("source"),
        F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").when(kind == "view", "DEBUG").otherwise("INFO").alias("severity"),
        (code * 1000 + k.cast("long")).cast("long").alias("template_id"), F.concat(kind, F.lit(" k="), k).alias("pattern"), F.concat(kind, F.lit(" "), F.col("props")).alias("message"),
        F.concat(kind, F.lit(" "), F.col("props")).alias("raw"), F.when(F.col("user_id") % 7 == 0, None).otherwise(F.concat(F.lit("u"), F.col("user_id"))).alias("trace_id"), "value",
    )


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.template_summary(log_events(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str, informative: bool = True) -> DataFrame:
    events = log_events(spark, sf_dir)
    rows = templates(spark, sf_dir)
    stats = aggregates.burst_stats(events, rows).join(rows.select("template_id", "pattern"), "template_id")
    return scoring.score(stats, aggregates.bucket_count(events), informative)


def scored_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_scores(templates(spark, sf_dir), scores(spark, sf_dir))


def ranking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, templates, scores) for a query that needs them several times: templates and scores are computed once and read from tables."""
    events = log_events(spark, sf_dir)
    rows = written(templates(spark, sf_dir))
    stats = aggregates.burst_stats(events, rows).join(rows.select("template_id", "pattern"), "template_id")
    return events, rows, written(scoring.score(stats, aggregates.bucket_count(events), True))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, line: the documents' lines, numbered from 1."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic notes over the templates: two findings, an accounting one, a conclusion, and one that cites nothing real."""
    rows = [
        (1, 1, "purchases", [3001, 3002], [1, 2, 3], "medium", "finding", False),
        (2, 2, "errors", [2001, 2002, 2003], [4], "high", "finding", False),
        (3, 3, "answering for views", [5001], [5], "low", "accounting", False),
        (4, 4, "conclusion", [2001, 3001], [1], "high", "finding", True),
        (5, 5, "nothing there", [99001], [-7], "low", "finding", False),
    ]
    from incidentlens.operators.notes import NOTE_SCHEMA

    return spark.createDataFrame(rows, NOTE_SCHEMA)


def iso(df: DataFrame) -> DataFrame:
    """Timestamps as fixed-width text, which both engines render alike."""
    return df.select(*[times.iso(F.col(n)).alias(n) if t.startswith("timestamp") else F.col(n) for n, t in df.dtypes])


# ---- the same as SQL

K = "regexp_extract(props, '([0-9]+)', 1)"
ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ')"
LOG_EVENTS = f"""log_events AS (
  SELECT event_id AS id, ts, 'svc-' || (user_id % 4) AS source,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS severity,
    CAST((CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END) * 1000 + CAST({K} AS BIGINT) AS BIGINT) AS template_id,
    event_type || ' k=' || {K} AS pattern, event_type || ' ' || props AS message, event_type || ' ' || props AS raw,
    CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'u' || user_id END AS trace_id, value
  FROM events)"""
RANK = "CASE {0} WHEN 'FATAL' THEN 5 WHEN 'ERROR' THEN 4 WHEN 'WARN' THEN 3 WHEN 'INFO' THEN 2 WHEN 'DEBUG' THEN 1 ELSE 0 END"
TEMPLATES = f"""templates AS (
  SELECT template_id, arg_max(pattern, (ts, id)) AS pattern, count(*) AS occurrence_count, min(ts) AS first_seen, max(ts) AS last_seen,
    max({RANK.format('severity')}) AS max_severity_rank, min({RANK.format('severity')}) AS min_severity_rank,
    count(*) FILTER (severity = 'TRACE') AS n_trace, count(*) FILTER (severity = 'DEBUG') AS n_debug, count(*) FILTER (severity = 'INFO') AS n_info,
    count(*) FILTER (severity = 'WARN') AS n_warn, count(*) FILTER (severity = 'ERROR') AS n_error, count(*) FILTER (severity = 'FATAL') AS n_fatal
  FROM log_events GROUP BY template_id)"""


def bucket_sql(minutes: int, ts: str = "ts") -> str:
    if minutes <= 1:
        return f"strftime({ts}, '%Y-%m-%dT%H:%M')"
    return f"strftime({ts}, '%Y-%m-%dT%H:') || (minute({ts}) // {minutes})"


def burst_sql(minutes: int = 1) -> str:
    return f"""burst AS (
  SELECT t.template_id, t.occurrence_count, t.max_severity_rank, coalesce(b.max_per_bucket, 0) AS max_per_bucket, coalesce(b.buckets, 0) AS buckets, t.pattern
  FROM templates t LEFT JOIN (SELECT template_id, max(n) AS max_per_bucket, count(*) AS buckets
    FROM (SELECT template_id, {bucket_sql(minutes)} AS b, count(*) AS n FROM log_events GROUP BY ALL) GROUP BY template_id) b USING (template_id)),
n_buckets AS (SELECT count(DISTINCT {bucket_sql(minutes)}) AS n_buckets FROM log_events)"""


LEXICAL = r"""CASE WHEN regexp_matches({0}, '(?i)\b(?:error|errors|failed|failure|failures|fail|fails|failing|fatal|panic|panicked|exception|traceback|assert|asserted|assertion|segfault|core dumped|aborted)\b') THEN 0.8::DOUBLE
  WHEN regexp_matches({0}, '(?i)\b(?:warn|warning|warnings|timeout|timed out|refused|denied|unable|cannot|could not|no such|not found|missing|invalid|undefined|unexpected|killed|non-zero|deprecated)\b') THEN 0.5::DOUBLE
  ELSE 0.15::DOUBLE END"""
WEIGHT = "CASE max_severity_rank WHEN 5 THEN 1.0::DOUBLE WHEN 4 THEN 0.8::DOUBLE WHEN 3 THEN 0.5::DOUBLE WHEN 2 THEN 0.15::DOUBLE WHEN 1 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END"


def scores_sql(source: str = "field") -> str:
    level = {"field": WEIGHT, "lexical": LEXICAL.format("pattern"), "none": "0.0::DOUBLE"}[source]
    w = "0.0::DOUBLE" if source == "none" else "0.5::DOUBLE"
    return f"""parts AS (
  SELECT template_id, {w} AS w, {level} AS s,
    CASE WHEN occurrence_count <= 1 OR max_per_bucket <= 0 OR n_buckets <= 1 OR max_per_bucket <= occurrence_count / n_buckets THEN 0.0::DOUBLE ELSE
      greatest(0.0::DOUBLE, -(max_per_bucket * ln(occurrence_count / n_buckets) - occurrence_count / n_buckets - lgamma(max_per_bucket + 1))) END AS surprise,
    CASE WHEN occurrence_count <= 0 OR most <= 1 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - ln(1.0::DOUBLE + occurrence_count) / ln(1.0::DOUBLE + most)) END AS r
  FROM burst, n_buckets, (SELECT max(occurrence_count) AS most FROM burst)),
scores AS (
  SELECT template_id, round((w * s + 0.3::DOUBLE * (surprise / (surprise + 10)) + 0.2::DOUBLE * r) / (w + 0.5::DOUBLE), 6) AS score, round(s, 6) AS severity,
    round(surprise / (surprise + 10), 6) AS burstiness, round(r, 6) AS rarity FROM parts)"""


def sql(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


BASE = (LOG_EVENTS, TEMPLATES)
SCORED = (LOG_EVENTS, TEMPLATES, burst_sql(), scores_sql(), """scored AS (SELECT t.*, coalesce(s.score, 0) AS anomaly_score FROM templates t LEFT JOIN scores s USING (template_id))""")
SIGNAL = """ranked AS (SELECT template_id, score, row_number() OVER (ORDER BY score DESC, template_id) AS rank, lead(score) OVER (ORDER BY score DESC, template_id) AS next FROM scores),
cut AS (SELECT coalesce((SELECT rank FROM ranked WHERE rank >= 3 AND rank < 15 AND next IS NOT NULL ORDER BY score - next DESC, rank LIMIT 1), least((SELECT count(*) FROM ranked), 15)) AS cut),
signal AS (SELECT template_id, score, rank FROM ranked, cut WHERE rank <= cut)"""
CHRONIC = """chronic AS (SELECT template_id FROM templates, (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM log_events)
  WHERE span > 0 AND epoch_us(last_seen) - epoch_us(first_seen) >= span * 0.9)"""
NOTES = """notes AS (SELECT * FROM (VALUES
  (1::BIGINT, 1::BIGINT, 'purchases', [3001, 3002]::BIGINT[], [1, 2, 3]::BIGINT[], 'medium', 'finding', false),
  (2, 2, 'errors', [2001, 2002, 2003], [4], 'high', 'finding', false),
  (3, 3, 'answering for views', [5001], [5], 'low', 'accounting', false),
  (4, 4, 'conclusion', [2001, 3001], [1], 'high', 'finding', true),
  (5, 5, 'nothing there', [99001], [-7], 'low', 'finding', false)) v(note_id, step, note, template_ids, log_event_ids, confidence, role, synthesis)),
cited AS (SELECT note_id, role, unnest(template_ids) AS template_id FROM notes)"""
DOC_LINES = """doc_lines AS (SELECT doc_id, CAST(unnest(range(1, len(parts) + 1)) AS BIGINT) AS line_no, unnest(parts) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))"""
