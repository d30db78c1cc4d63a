"""Five tools over an incident's tables; errors come back as results, and citing needs having seen."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from incidentlens.functions import texts, times
from incidentlens.functions.severity import ALIASES, LEVELS
from incidentlens.operators import reads
from incidentlens.operators.notes import NoteError
from incidentlens.operators.store import Store
from incidentlens.plans import guard

SLICE, TEMPLATES, SQL_ROWS = (60, 200), (15, 50), 200
RESULT_CHARS, LEAST_CELL, MOST_CELL = 12_000, 200, 4000
NAMES = ("query_templates", "get_slice", "run_sql", "read_notes", "write_note")


class ToolError(ValueError):
    """Arguments a tool can't take."""


def cell(value, limit: int) -> str:
    if value is None:
        return "-"
    flat = " ".join(str(f"{value:.3f}" if isinstance(value, float) else value).split())
    return flat if len(flat) <= limit else f"{flat[:limit]}...(+{len(flat) - limit} more chars)"


def table(columns: list[str], rows: list) -> str:
    """A legend and a line per row; cells share a budget of characters."""
    allowance = min(MOST_CELL, max(LEAST_CELL, RESULT_CHARS // max(1, len(rows) * len(columns))))
    return "\n".join(["columns: " + " | ".join(columns), *(" | ".join(cell(v, allowance) for v in r) for r in rows)])


def fence_text(text: str, kind: str) -> str:
    """Log text as a data block (driver-side twin of ``texts.fence``)."""
    import re

    tag = texts._BLOCK
    safe = re.sub(rf"(?i)(?:<|&lt;|&#0*60;|&#x0*3c;|＜)(\s*/?\s*){tag}", rf"‹\g<1>{tag}", text)
    return f'<{tag} kind="{kind}">\n{safe}\n</{tag}>'


def whole(value, name: str) -> int:
    try:
        if isinstance(value, bool) or int(value) != float(value):
            raise ValueError
        return int(value)
    except (TypeError, ValueError):
        raise ToolError(f"{name} must be a whole number") from None


def limit_of(args: dict, bounds: tuple[int, int], name: str = "limit") -> int:
    value = args.get(name)
    return bounds[0] if value is None else reads.clamp(whole(value, name), *bounds, name)


@dataclass
class Toolbox:
    store: Store
    step: int = 0
    seen_events: set[int] = field(default_factory=set)
    opened: set[int] = field(default_factory=set)
    nudged: set[int] = field(default_factory=set)

    def dispatch(self, name: str, args: dict) -> str:
        """The tool's text; what went wrong is a result too, so that the model can mend it.  Every call is logged."""
        self.step += 1
        try:
            if name not in NAMES:
                raise ToolError(f"no tool {name!r}; there are {', '.join(NAMES)}")
            text, rows = getattr(self, name)(args)
        except (ToolError, NoteError, guard.ReadOnlyViolation, ValueError) as e:
            text, rows = f"error: {e}", 0
        self.store.log_query(self.step, f"{name}({', '.join(f'{k}={v!r}' for k, v in sorted(args.items()))})", rows)
        return text

    def query_templates(self, args: dict) -> tuple[str, int]:
        order = str(args.get("order_by") or "anomaly_score").lower()
        templates = self.store.read("templates")
        rows = reads.top_templates(templates, limit_of(args, TEMPLATES), order).collect()
        names = ["template_id", "pattern", "occurrence_count", "first_seen", "last_seen", "max_severity_rank", "anomaly_score"]
        body = table([*names[:5], "max_severity", names[6]], [[*(r[n] for n in names[:5]), LEVELS[r["max_severity_rank"]], r["anomaly_score"]] for r in rows])
        return f"{len(rows)} templates\n{fence_text(body, 'templates')}", len(rows)

    def get_slice(self, args: dict) -> tuple[str, int]:
        where: dict = {}
        for key, name in (("start_ts", "start"), ("end_ts", "end")):
            if args.get(key):
                ok = self.store.spark.range(1).select(times.parse(F.lit(str(args[key]))).cast("string")).first()[0]
                if ok is None:
                    raise ToolError(f"{key} isn't a timestamp: {args[key]!r}")
                where[name] = ok
        if args.get("severity"):
            level = ALIASES.get(str(args["severity"]).strip().upper())
            if level is None:
                raise ToolError(f"unknown severity {args['severity']!r}")
            where["severity"] = level
        for key in ("source", "trace_id"):
            if args.get(key):
                where[key] = str(args[key])
        if args.get("template_id") is not None:
            where["template_id"] = whole(args["template_id"], "template_id")
        rows = self.store.slice(limit_of(args, SLICE, "max_lines"), **where).collect()
        total = self.store.slice_count(**where).first()[0]
        self.seen_events.update(r["id"] for r in rows)
        self.opened.update(r["template_id"] for r in rows)
        body = table(["id", "ts", "source", "severity", "template_id", "message"], [[r["id"], r["ts"], r["source"] or reads.UNKNOWN, r["severity"], r["template_id"], r["message"] or r["raw"]] for r in rows])
        return f"{len(rows)} of {total} events\n{fence_text(body, 'events')}", len(rows)

    def run_sql(self, args: dict) -> tuple[str, int]:
        if not str(args.get("query") or "").strip():
            raise ToolError("query is empty")
        views = {"log_events": self.store.read("events").withColumn("ts_iso", times.iso(F.col("ts"))), "templates": self.store.read("templates")}
        found = guard.run_readonly(self.store.spark, args["query"], views, SQL_ROWS, guard.SECONDS)
        rows = found.collect()
        if "id" in found.columns and "log_events" in guard.relations(self.store.spark, args["query"]):
            self.seen_events.update(r["id"] for r in rows if isinstance(r["id"], int))
        return f"{len(rows)} rows\n{fence_text(table(found.columns, [list(r) for r in rows]), 'rows')}", len(rows)

    def read_notes(self, args: dict) -> tuple[str, int]:
        rows = self.store.read("notes").orderBy("step", "note_id").collect()
        return table(["note_id", "step", "confidence", "note"], [[r["note_id"], r["step"], r["confidence"], r["note"]] for r in rows]), len(rows)

    def write_note(self, args: dict) -> tuple[str, int]:
        evidence = args.get("evidence") or {}
        ids = [whole(x, "template_ids") for x in evidence.get("template_ids") or []]
        note = {
            "step": self.step, "note": str(args.get("note") or ""), "template_ids": ids, "log_event_ids": [whole(x, "log_event_ids") for x in evidence.get("log_event_ids") or []],
            "confidence": str(args.get("confidence") or "").lower(), "role": "accounting" if ids and set(ids) <= self.nudged else "finding",
        }
        number = self.store.write_note(note, self.seen_events)
        asked = self.store.spark.createDataFrame([(i,) for i in ids], "template_id long")
        missing = [r[0] for r in reads.unresolved(asked, self.store.read("templates"), "template_id").collect()] if ids else []
        return f"note {number} written" + (f"; no such templates: {missing}" if missing else ""), 1
