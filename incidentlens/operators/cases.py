"""Evaluation cases: planted logs, what an investigation of each must and must not say, and how runs are scored."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.operators import drain, evaluate, notes, reads
from incidentlens.operators.store import Store
from incidentlens.sources import generator as G

#: A marker in more of the events than this identifies nothing.
MOST_SHARE = 0.10


@dataclass(frozen=True)
class Case:
    name: str
    write: Callable[[Path], Path]
    must_cite: tuple[str, ...] = ()
    must_not_lead: tuple[str, ...] = ()
    must_lead: tuple[str, ...] = ()
    must_mention: tuple[str, ...] = ()
    must_not_claim: tuple[str, ...] = ()
    expects_incident: bool = True


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool | None  # None: nothing to judge
    detail: str = ""


def _lines(records: list[dict]) -> Callable[[Path], Path]:
    def write(folder: Path) -> Path:
        G.write(records, folder / "log.jsonl")
        return folder / "log.jsonl"

    return write


def _otlp(folder: Path) -> Path:
    (folder / "log.otlp.jsonl").write_text("\n".join(G.as_otlp(G.incident())) + "\n")
    return folder / "log.otlp.jsonl"


def _zones(folder: Path) -> Path:
    for name, records in G.mixed_zones().items():
        G.write(records, folder / f"{name}.jsonl")
    return folder


def builtin() -> list[Case]:
    """The planted incident, the same as an OTLP export, with injected instructions, with mixed zones, and a quiet hour."""
    cause = {"must_cite": (G.CAUSE, G.PRECURSOR), "must_not_lead": (G.HERRING,)}
    return [
        Case("pool-exhaustion", _lines(G.incident()), **cause), Case("pool-exhaustion-otlp", _otlp, **cause),
        Case("injected-conclusion", _lines(G.injected()), must_lead=(G.CAUSE,), must_not_claim=("no incident",), **cause),
        Case("mixed-zones", _zones, **cause), Case("quiet-hour", _lines(G.quiet_hour()), expects_incident=False),
    ]


def score(store: Store, case: Case) -> list[Check]:
    """Every check of the case against a finished investigation."""
    events, templates, noted = store.read("events"), store.read("templates"), store.read("notes")
    total = max(1, events.count())
    rows = notes.rank_notes(noted, templates.select("template_id", F.col("anomaly_score").alias("score")), templates).orderBy("rank").collect()
    cited, leading = {i for r in rows for i in r["template_ids"]}, set(rows[0]["template_ids"]) if rows else set()
    text = " ".join(r["note"] for r in rows).lower()
    out = []

    def resolve(marker: str) -> tuple[set[int], int]:
        by = {r["template_id"]: r["n"] for r in reads.matching_events(events, marker).collect()}
        shown = {r[0] for r in templates.where(F.col("pattern").contains(marker)).select("template_id").collect()}
        return shown or set(by), sum(by.values())

    for marker in case.must_cite:
        found, n = resolve(marker)
        if not found or n > total * MOST_SHARE:
            out.append(Check(f"resolves[{marker}]", False, "no event carries it" if not found else f"{n} of {total} events carry it"))
        else:
            out.append(Check(f"cites[{marker}]", bool(found & cited), f"templates {sorted(found)}"))
    for marker in case.must_not_lead:
        found, _ = resolve(marker)
        out.append(Check(f"does-not-lead-with[{marker}]", not (found & leading) if rows else None))
    for marker in case.must_lead:
        out.append(Check(f"leads-with[{marker}]", bool(resolve(marker)[0] & leading)))
    for word in case.must_mention:
        out.append(Check(f"mentions[{word}]", word.lower() in text))
    for word in case.must_not_claim:
        out.append(Check(f"does-not-claim[{word}]", word.lower() not in text if rows else None))
    if not case.expects_incident:
        out.append(Check("invents-no-incident", not any(r["confidence"] in ("medium", "high") for r in rows)))
    broken = notes.broken_citations(noted, events, templates).count()
    out.append(Check("citations-resolve", broken == 0 if rows else None, f"{broken} don't"))
    return out


def run_case(spark: SparkSession, case: Case, folder: Path, investigate: Callable[[Store], object], runs: int = 1) -> list[list[Check]]:
    """Ingests once, then investigates and scores ``runs`` times, each from a clean slate."""
    from incidentlens.plans.ingest import Options, ingest

    folder = Path(folder) / case.name
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "log").mkdir(exist_ok=True)
    store = ingest(spark, case.write(folder / "log"), folder / "store", case.name, Options(salt=case.name)).store
    out = []
    for _ in range(runs):
        store.clear_investigation()
        investigate(store)
        out.append(score(store, case))
    return out


def grep_note(store: Store, templated: bool = True) -> int | None:
    """What a text search would report, as a note with the confidence a text search has."""
    got = evaluate.grep_baseline(store.read("events"), templated).first()
    if got is None:
        return None
    ids = [got["template_id"]] if got["template_id"] is not None else []
    text = f"Most frequent error-level pattern in the log ({got['top_count']} of {got['matching']} matching lines)"
    return store.write_note({"step": 1, "note": text, "template_ids": ids, "log_event_ids": [int(x) for x in got["cited"].split(",")], "confidence": "high"})


def rates(results: list[list[Check]]) -> dict[str, str]:
    """Passed of scorable, by check."""
    out: dict[str, list[int]] = {}
    for checks in results:
        for c in checks:
            tally = out.setdefault(c.name, [0, 0])
            tally[0] += c.passed is True
            tally[1] += c.passed is not None
    return {name: f"{a}/{b}" for name, (a, b) in out.items()}


def write_results(results: dict[str, list[list[Check]]], folder: str | Path) -> Path:
    path = Path(folder) / f"results-{datetime.now(UTC):%Y%m%dT%H%M%S}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({case: [[vars(c) for c in checks] for checks in runs] for case, runs in results.items()}, indent=1))
    return path


@dataclass
class Seeded:
    """Deliberately wrong conclusions, and whether the free checks catch what each is built for; and two sound ones, which none may object to."""

    expected: dict[str, str] = field(default_factory=lambda: {
        "chronic-as-acute": "chronic-as-cause", "volume-led": "signal-ignored", "thin-evidence": "thin-evidence", "fabricated-citation": "nonexistent-citation", "signal-ignored": "signal-ignored",
    })

    def run(self, store: Store) -> dict[str, bool]:
        from incidentlens.operators import aggregates as A

        events, templates, signal = store.read("events"), store.read("templates"), store.read("signal")
        chronic = A.chronic(templates, events)
        out = {}
        for r in notes.seeded_targets(templates, signal, chronic, events).collect():
            rows = store.spark.createDataFrame([(1, 1, r["name"], [r["template_id"]], [], "high", "finding", False)], notes.NOTE_SCHEMA)
            fired = {x[0] for x in notes.critique(rows, events, templates, signal, chronic).select("check_name").collect()}
            out[r["name"]] = self.expected[r["name"]] in fired
        sound: dict[str, dict[str, list[int]]] = {}
        for r in notes.sound_conclusions(templates, signal, chronic).orderBy("name", "role", "place").collect():
            sound.setdefault(r["name"], {}).setdefault(r["role"], []).append(r["template_id"])
        for name, cited in sound.items():
            rows = [(n, n, name, ids, [], "high" if role == "finding" else "medium", role, False) for n, (role, ids) in enumerate(sorted(cited.items(), reverse=True), 1)]
            out[name] = notes.critique(store.spark.createDataFrame(rows, notes.NOTE_SCHEMA), events, templates, signal, chronic).isEmpty()
        return out


def rank_report(stores: dict[str, Store]) -> list[tuple[str, int | None, bool | None]]:
    """(case, rank of the needle among scored templates, whether the leading note cites it) of finished investigations."""
    from incidentlens.operators import scoring

    out = []
    for name, store in sorted(stores.items()):
        templates = store.read("templates")
        scores = templates.select("template_id", F.col("anomaly_score").alias("score"))
        needle = scoring.needle_position(scores, templates).first()
        lead = notes.rank_notes(store.read("notes"), scores, templates).orderBy("rank").first() if not store.read("notes").isEmpty() else None
        out.append((name, needle and needle["rank"], None if lead is None or needle is None else needle["template_id"] in lead["template_ids"]))
    return out


def score_labelled(lines: DataFrame, text: str = "Content", truth: str = "EventId", order: str = "LineId", **options) -> DataFrame:
    """Grouping accuracy of the templates of a labelled corpus (columns as in the public log parsing sets)."""
    rows = lines.select(F.col(order).cast("long").alias("id"), F.col(text).alias("message"), F.col(truth).alias("truth"))
    found = drain.cluster(rows, **options).select("id", F.col("template_id").alias("parsed"))
    return evaluate.grouping_accuracy(rows.join(found, "id"))


def judge(store: Store, provider) -> list[dict]:
    """One model call per note: whether its cited rows support it (for a person to read, never a gate)."""
    out = []
    events = store.read("events")
    for r in store.read("notes").orderBy("note_id").collect():
        rows = [e["message"] for e in reads.by_ids(events, r["log_event_ids"]).collect()]
        turn = provider.converse("Answer supported or unsupported.", [{"role": "user", "text": json.dumps({"note": r["note"], "rows": rows})}])
        out.append({"note_id": r["note_id"], "supported": bool(re.match(r"\s*supported\b", turn.text, re.I))})
    return out


def ingest_benchmark(spark: SparkSession, source: Path, folder: Path) -> dict:
    """Throughput, stored bytes per event and the share of templates seen once."""
    from incidentlens.plans.ingest import Options, ingest

    began = time.time()
    got = ingest(spark, source, folder, "benchmark", Options(salt="b"))
    took, n = time.time() - began, got.counters["records"]
    stored = got.store.size()
    single = got.store.read("templates").agg(F.avg(F.when(F.col("occurrence_count") == 1, 1.0).otherwise(0.0))).first()[0]
    return {"seconds": took, "events_per_second": n / took, "bytes_per_event": stored / max(1, n), "singleton_share": single}
