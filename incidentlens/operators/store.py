"""Incident tables: one folder per incident with a table each, every write whole or not at all (``commits``).

Events are laid out for slices: by slots of time, in a slot sorted by severity and time, with Bloom filters on the trace id, and
beside them an index from trace id to slots.  A slice by time or trace reads the folders of its slots alone.
"""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentlens.operators import notes as N
from incidentlens.operators import reads
from incidentlens.operators.commits import Files, Table

SCHEMAS = {
    "incident": "incident_id string, created_at timestamp, source string, format string, redaction string, brief string",
    "notes": N.NOTE_SCHEMA,
    "query_log": "step long, query string, row_count long, at timestamp",
    "metrics": "stage string, metric string, value string, value_num double, at timestamp",
    "objections": "objection_id string, claim string, objection string, severity string, response string, conceded boolean",
    "critique": "outcome string, assessment string, alternative string, revised_confidence string",
}
QUERY_CHARS = 500
#: Slots by length of the time's text: minute, hour, day, month.  An incident takes the finest that has SLOT_ROWS events on average and at most MOST_SLOTS.
SLOT_CHARS, SLOT_ROWS, MOST_SLOTS, TRACE_BUCKETS = (16, 13, 10, 7), 100_000, 1500, 64


def incident_id(source: str, now: datetime | None = None) -> str:
    """The UTC date and a slug of the file's stem."""
    stem = re.sub(r"[^a-z0-9]+", "-", PurePosixPath(source).stem.lower()).strip("-") or "incident"
    return f"{(now or datetime.now(UTC)):%Y-%m-%d}-{stem}"


class Store:
    """The tables of one incident below ``root``, a path of any file system that Hadoop opens."""

    def __init__(self, spark: SparkSession, root, incident: str):
        if not re.fullmatch(r"[A-Za-z0-9._-]+", incident) or incident.startswith("."):
            raise ValueError(f"not an incident id: {incident!r}")
        self.spark, self.incident, self.root = spark, incident, str(root).rstrip("/")
        self.files = Files(spark, f"{self.root}/{incident}")
        self.folder = self.files.folder

    def table(self, name: str) -> Table:
        found = Table(self.spark, self.files, name)
        self._adopt(found)
        return found

    def _adopt(self, table: Table) -> None:
        """Version 1 kept a pointer file beside a table's folder: the folder becomes the first commit's part."""
        pointer = self.files.at(f"{table.name}.json")
        if not self.files.exists(pointer):
            return
        old = json.loads(self.files.read(pointer))["path"]
        if table.latest()[1] is None:
            schema = self.spark.read.parquet(self.files.at(old)).schema.jsonValue()
            table.commit(lambda content: content or {"parts": [f"../{old}"], "schema": schema, "slots": None})
        self.files.delete(pointer)

    def exists(self, name: str) -> bool:
        return self.table(name).latest()[1] is not None

    def read(self, name: str) -> DataFrame:
        """A table's last version; a small table that was never written is empty."""
        if name == "events":
            return self.events().drop("slot")
        return self._read(name)

    def _read(self, name: str) -> DataFrame:
        found = self.table(name).read()
        if found is not None:
            return found
        if name in SCHEMAS:
            return self.spark.createDataFrame([], SCHEMAS[name])
        raise KeyError(f"no table {name!r} in {self.incident}")

    def replace(self, name: str, df: DataFrame) -> None:
        if name == "events":
            self.write_events(df)
        else:
            self.table(name).replace(df)

    def append(self, name: str, rows: list[tuple]) -> None:
        """Adds a few rows to a small table."""
        self.table(name).append(lambda _: self.spark.createDataFrame(rows, SCHEMAS[name]))

    def drop(self, name: str) -> None:
        self.table(name).drop()

    def size(self) -> int:
        """Bytes of all that is stored."""
        return self.files.size(self.folder)

    # ---- events

    def write_events(self, df: DataFrame, slot_rows: int = SLOT_ROWS) -> None:
        """Replaces the events.  A raw line that is the message is stored once; an event without a time has a slot of its own.

        ``df`` is read three times: to choose the slots, for the events, and (their ids and slots only) for the index.
        """
        text = F.date_format("ts", "yyyy-MM-dd HH:mm")
        counts = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(F.substring(text, 1, c)).alias(str(c)) for c in SLOT_CHARS]).first()
        chars = next((c for c in SLOT_CHARS if counts[str(c)] <= min(MOST_SLOTS, max(1, counts["n"] / slot_rows))), SLOT_CHARS[-1])
        same = F.col("raw").eqNullSafe(F.col("message"))
        rows = df.withColumn("_same", same).withColumn("raw", F.when(~F.col("_same"), F.col("raw"))).withColumn("slot", F.coalesce(F.substring(text, 1, chars), F.lit("none")))
        ordered = rows.repartitionByRange("slot", "severity", "ts", "id").sortWithinPartitions("slot", "severity", "ts", "id")
        # A filter takes its size from how many traces a slot is expected to hold; without that it would be a megabyte in every file.
        traces = min(1_000_000, max(64, 2 * counts["n"] // max(1, counts[str(chars)])))
        options = {"parquet.bloom.filter.enabled#trace_id": "true", "parquet.bloom.filter.expected.ndv#trace_id": str(traces)} if "trace_id" in df.columns else {}
        table = self.table("events")
        table.replace(ordered, "slot", **options)
        if "trace_id" in df.columns:
            traces = self._stored().where("trace_id is not null").groupBy("trace_id", "slot").agg(F.count("*").alias("n"))
            bucket = self._bucket(F.col("trace_id"))
            self.table("traces").replace(traces.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "trace_id"), "bucket")

    @staticmethod
    def _bucket(trace):
        return F.pmod(F.xxhash64(trace), F.lit(TRACE_BUCKETS)).cast("string")

    def _stored(self) -> DataFrame:
        return self._read("events")

    def events(self, trace_id: str | None = None) -> DataFrame:
        """The events with ``slot``, of a trace those of the slots that the index names for it."""
        rows = self._stored()
        if "_same" in rows.columns:
            rows = rows.withColumn("raw", F.when(F.col("_same"), F.col("message")).otherwise(F.col("raw"))).drop("_same")
        if "slot" not in rows.columns:  # as version 1 stored them
            return rows.withColumn("slot", F.lit(None).cast("string"))
        traces = self.table("traces").read() if trace_id is not None else None
        if traces is None:
            return rows
        bucket = self.spark.range(1).select(self._bucket(F.lit(trace_id))).first()[0]
        slots = [r["slot"] for r in traces.where((F.col("bucket") == bucket) & (F.col("trace_id") == trace_id)).select("slot").distinct().collect()]  # MOST_SLOTS or few more
        return rows.where(F.col("slot").isin(slots))

    def slice(self, limit: int | None = None, **where) -> DataFrame:
        """A slice's rows in order, from the folders that can hold them; all of them without a limit."""
        rows = reads.matching(self.events(where.get("trace_id")), **where).drop("slot").orderBy("ts", "id")
        return rows if limit is None else rows.limit(limit)

    def slice_count(self, **where) -> DataFrame:
        return reads.slice_count(self.events(where.get("trace_id")), **where)

    # ---- the incident, notes and metrics

    def create(self, source: str, fmt: str | None = None, redaction: str | None = None, brief: str | None = None) -> None:
        self.replace("incident", self.spark.createDataFrame([(self.incident, datetime.now(UTC), source, fmt, redaction, brief)], SCHEMAS["incident"]))

    def row(self) -> dict | None:
        """The incident's row, if it has one."""
        found = self.read("incident").orderBy("created_at").first()
        return found.asDict() if found else None

    def rename(self, incident: str) -> "Store":
        """The same tables under another id; an id that is taken is refused."""
        other = Store(self.spark, self.root, incident)
        try:
            self.files.move(self.folder, other.folder)
        except ValueError:
            raise ValueError(f"{incident} exists") from None
        other.replace("incident", other.read("incident").withColumn("incident_id", F.lit(incident)))
        return other

    def write_note(self, note: dict, seen_events: set[int] | None = None) -> int:
        """Validates and appends a note; its id, which no other note has however many write at once."""
        N.validate_note(note, seen_events)
        number = 0

        def row(before: DataFrame | None) -> DataFrame:
            nonlocal number
            number = ((before.agg(F.max("note_id")).first()[0] if before is not None else 0) or 0) + 1
            values = (number, note["step"], note["note"], note.get("template_ids") or [], note.get("log_event_ids") or [], note["confidence"], note.get("role") or "finding", bool(note.get("synthesis")))
            return self.spark.createDataFrame([values], SCHEMAS["notes"])

        self.table("notes").append(row)
        return number

    def log_query(self, step: int, query: str, row_count: int) -> None:
        self.append("query_log", [(step, query[:QUERY_CHARS], row_count, datetime.now(UTC))])

    def record(self, stage: str, values: dict) -> None:
        """Metrics of a stage; a later value of the same metric replaces the earlier one."""
        rows = []
        for name, value in values.items():
            number = float(value) if isinstance(value, (bool, int, float)) else None
            rows.append((stage, name, None if value is None else str(value), number, datetime.now(UTC)))
        fresh = self.spark.createDataFrame(rows, SCHEMAS["metrics"])
        order = Window.partitionBy("stage", "metric").orderBy(F.desc("at"))
        table = self.table("metrics")

        def merged(content: dict | None) -> dict:
            before = fresh.limit(0) if content is None else table.frame(content)
            both = before.union(fresh).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
            return table.write_part(both.coalesce(1))

        table.commit(merged)

    def metrics(self) -> dict[tuple[str, str], str | None]:
        return {(r["stage"], r["metric"]): r["value"] for r in self.read("metrics").collect()}  # a row per declared metric

    def save_critique(self, outcome: str, assessment: str = "", alternative: str = "", confidence: str = "", objections: list[tuple] = ()) -> None:
        """Replaces any earlier critique."""
        self.replace("critique", self.spark.createDataFrame([(outcome, assessment, alternative, confidence)], SCHEMAS["critique"]))
        self.replace("objections", self.spark.createDataFrame(list(objections), SCHEMAS["objections"]))

    def clear_investigation(self) -> dict[str, int]:
        """Drops notes, queries and critique; how many of each there were."""
        out = {}
        for name in ("notes", "query_log", "objections", "critique"):
            out[name] = self.read(name).count()
            self.replace(name, self.spark.createDataFrame([], SCHEMAS[name]))
        return out
