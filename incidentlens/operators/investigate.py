"""The deterministic investigation: the worst template, its first events, one cautious note."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.functions.severity import LEVELS
from incidentlens.operators import reads

EVIDENCE_EVENTS, SLICE_LIMIT = 5, 50


def skeleton(events: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per cited event of the single note: its template's facts beside the event; none without templates."""
    target = reads.top_templates(templates, 1, "severity")
    named = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("max_severity_rank") + 1)
    facts = F.broadcast(target.select("template_id", "pattern", named.alias("severity"), "occurrence_count", "first_seen", "last_seen"))  # one row
    rows = events.select(F.col("id").alias("event_id"), F.col("ts").alias("event_ts"), "message", F.col("template_id").alias("_t"))
    cited = rows.join(facts, F.col("_t") == F.col("template_id")).orderBy("event_ts", "event_id").limit(EVIDENCE_EVENTS)
    return cited.select("template_id", "pattern", "severity", "occurrence_count", "first_seen", "last_seen", "event_id", "event_ts", "message", F.lit("low").alias("confidence"))


def note_text(row: dict) -> str:
    return (
        f"Highest-severity recurring template is #{row['template_id']}: \"{row['pattern']}\". It reached {row['severity']} and occurred "
        f"{row['occurrence_count']} times between {row['first_seen']} and {row['last_seen']}. Representative line: {row['message']}"
    )


def skeleton_note(rows: list[dict], step: int = 3) -> dict | None:
    """The note of the rows that ``skeleton`` gave."""
    if not rows:
        return None
    return {
        "note_id": 1, "step": step, "note": note_text(rows[0]), "template_ids": [rows[0]["template_id"]], "log_event_ids": [r["event_id"] for r in rows],
        "confidence": "low", "role": "finding", "synthesis": False,
    }
