"""Six tools over JSON-RPC lines (the Model Context Protocol's tool calls): ingest, health, investigate, report, report_data, query.

Sources are read from allowed folders only, links followed; one writer works on an incident at a time.
"""

from __future__ import annotations

import json
import sys
import threading
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

from incidentlens.agent import loop
from incidentlens.operators import health
from incidentlens.operators.store import Store
from incidentlens.plans import guard, report
from incidentlens.plans.ingest import Options, ingest

PROTOCOL = "2025-06-18"
TOOLS = {
    "ingest": ("Reads, redacts and templates a log file or folder into an incident.", {"source": True, "incident_id": False, "brief": False}, False),
    "health": ("The twelve checks of an incident's log.", {"incident_id": True}, False),
    "investigate": ("Writes cited notes; refused after a failed health check.", {"incident_id": True, "restart": False}, False),
    "report": ("The report as text.", {"incident_id": True, "format": False}, True),
    "report_data": ("The report's facts as JSON.", {"incident_id": True}, True),
    "query": ("The rows of one SELECT over log_events and templates.", {"incident_id": True, "sql": True}, True),
}


class Refused(ValueError):
    """A call that the server won't carry out."""


class Server:
    def __init__(self, spark: SparkSession, root: str | Path, allowed: list[str | Path], options: Options = Options(), investigate: Callable[[Store], object] = loop.skeleton):
        self.spark, self.root, self.options, self.run = spark, Path(root), options, investigate
        self.allowed = [Path(p).resolve() for p in allowed]
        self._busy: set[str] = set()
        self._lock = threading.Lock()

    def source(self, text: str) -> Path:
        """The path, links followed; it and every file below must lie in an allowed folder."""
        path = Path(text).resolve()
        for one in [path, *(path.rglob("*") if path.is_dir() else ())]:
            if not any(one.resolve().is_relative_to(root) for root in self.allowed):
                raise Refused(f"{one} is outside the allowed folders")
        if not path.exists():
            raise Refused(f"{text} doesn't exist")
        return path

    @contextmanager
    def writing(self, incident: str):
        with self._lock:
            if incident in self._busy:
                raise Refused(f"{incident} is being written")
            self._busy.add(incident)
        try:
            yield
        finally:
            with self._lock:
                self._busy.discard(incident)

    def store(self, incident: str) -> Store:
        store = Store(self.spark, self.root, incident)
        if not store.exists("events"):
            raise Refused(f"no incident {incident!r}")
        return store

    def ingest(self, source: str, incident_id: str | None = None, brief: str | None = None) -> dict:
        from dataclasses import replace

        from incidentlens.operators.store import incident_id as named

        path = self.source(source)
        incident = incident_id or named(str(path))
        with self.writing(incident):
            got = ingest(self.spark, path, self.root, incident, replace(self.options, brief=brief))
        return {"incident_id": incident, "counters": got.counters, "redactions": got.redactions, "verdict": got.report.verdict}

    def health(self, incident_id: str) -> dict:
        store = self.store(incident_id)
        found = health.report(store.read("events"), store.read("templates"), {k[1]: float(v) for k, v in store.metrics().items() if k[0] == "ingest" and k[1] in ("lines_read", "parse_errors")}, self.options.thresholds)
        with self.writing(incident_id):
            store.record("health", {**found.metrics, "verdict": found.verdict})
        return {"verdict": found.verdict, "checks": [{"check": c, "status": s, "message": m} for c, s, m in found.checks]}

    def investigate(self, incident_id: str, restart: bool = False) -> dict:
        store = self.store(incident_id)
        if store.metrics().get(("health", "verdict")) == health.FAIL:
            raise Refused("the log's health check failed")
        if not restart and not store.read("notes").isEmpty():
            raise Refused("there are notes already; ask for a restart")
        with self.writing(incident_id):
            store.clear_investigation()
            self.run(store)
        return {"notes": store.read("notes").count()}

    def report(self, incident_id: str, format: str = "markdown") -> str:
        return report.render(report.collect(self.store(incident_id)), format)

    def report_data(self, incident_id: str) -> dict:
        return report.jsonable(report.collect(self.store(incident_id)))

    def query(self, incident_id: str, sql: str) -> dict:
        store = self.store(incident_id)
        found = guard.run_readonly(self.spark, sql, {"log_events": store.read("events"), "templates": store.read("templates")}, time_limit=guard.SECONDS)
        return {"columns": found.columns, "rows": [[str(v) if v is not None and not isinstance(v, (bool, int, float, str)) else v for v in r] for r in found.collect()]}

    def call(self, name: str, arguments: dict) -> dict:
        """A tool's result as the protocol has it; what was refused is a result too, marked as an error."""
        try:
            if name not in TOOLS:
                raise Refused(f"no tool {name!r}; there are {', '.join(TOOLS)}")
            known = TOOLS[name][1]
            if wrong := set(arguments) - set(known) or {k for k, needed in known.items() if needed and k not in arguments}:
                raise Refused(f"unknown or missing arguments: {', '.join(sorted(wrong))}")
            got = getattr(self, name)(**arguments)
            return {"content": [{"type": "text", "text": got if isinstance(got, str) else json.dumps(got, ensure_ascii=False)}], "isError": False}
        except (ValueError, OSError, guard.ReadOnlyViolation) as e:
            return {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}

    def answer(self, message: dict) -> dict | None:
        """The reply to one JSON-RPC message; none to a notification."""
        if "id" not in message:
            return None
        method, params = message.get("method"), message.get("params") or {}
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "incidentlens", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": [
                {"name": n, "description": text, "annotations": {"readOnlyHint": reads},
                 "inputSchema": {"type": "object", "properties": {a: {"type": "boolean" if a == "restart" else "string"} for a in args}, "required": [a for a, needed in args.items() if needed]}}
                for n, (text, args, reads) in TOOLS.items()
            ]}
        elif method == "tools/call":
            result = self.call(str(params.get("name")), params.get("arguments") or {})
        elif method == "ping":
            result = {}
        else:
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no method {method!r}"}}
        return {"jsonrpc": "2.0", "id": message["id"], "result": result}

    def serve(self, lines=None, out=None) -> None:
        """A message a line in, a reply a line out."""
        out = out or sys.stdout
        for line in lines or sys.stdin:
            try:
                reply = self.answer(json.loads(line))
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if reply is not None:
                print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
