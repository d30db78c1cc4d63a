"""From a log file or folder to an incident's tables: read, redact, template, score, check."""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from incidentlens.functions import texts
from incidentlens.operators import aggregates as A
from incidentlens.operators import drain, health, reads, redaction, scoring
from incidentlens.operators.commits import Files
from incidentlens.operators.store import Store, incident_id
from incidentlens.sources import files
from incidentlens.sources import records as R
from incidentlens.sources.scratch import scratch

UNINFORMATIVE = 0.9
UNCOMPRESSIBLE_CAP = 2000
MOST_IDS = 50


@dataclass(frozen=True)
class Options:
    reader: str | None = None
    bootstrap: bool = False
    year: int | None = None
    clf: bool = False
    schemas: str | None = None
    redact: bool = True
    entities: tuple[str, ...] = redaction.DEFAULT_ENTITIES
    salt: str = ""
    vault: str | None = None
    calibrate: bool = True
    sim_th: float = 0.4
    depth: int = 4
    max_clusters: int = 10_000
    signal: tuple[int, int] = (3, 15)
    brief: str | None = None
    thresholds: health.Thresholds = field(default_factory=health.Thresholds)

    def __post_init__(self):
        if not 0 < self.sim_th <= 1 or self.depth < 3 or self.max_clusters < 1:
            raise ValueError("need 0 < sim_th <= 1, depth >= 3 and a positive cluster cap")
        if not 0 < self.signal[0] <= self.signal[1]:
            raise ValueError("signal bounds must be positive and in order")
        redaction.Redactor("", self.entities)


@dataclass
class Result:
    store: Store
    counters: dict
    report: health.Report
    redactions: dict[str, int]
    template_status: str


def _masked(events: DataFrame, raw_reader: bool) -> DataFrame:
    text = F.coalesce("message", "raw")
    return events.select("id", texts.mask_transport(texts.mask_header(text) if raw_reader else text).alias("message"))


def _redacted(events: DataFrame, options: Options) -> DataFrame:
    if not options.redact:
        return events.withColumn("redactions", F.array().cast("array<struct<entity:string,token:string,value:string>>"))
    return redaction.redact_columns(events, _redactor(options))


def _redactor(options: Options) -> redaction.Redactor:
    return redaction.Redactor(options.salt, options.entities)


def _brief(options: Options) -> str | None:
    """The brief as it may be stored and shown to a model."""
    return options.brief if options.brief is None or not options.redact else _redactor(options).redact(options.brief)


def _read(spark: SparkSession, source: str | Path, options: Options, told: list[dict]):
    return files.read_source(spark, source, name=options.reader, allow_bootstrap=options.bootstrap, year=options.year, clf=options.clf, schemas=options.schemas, told=told)


def _told(told: list[dict], options: Options) -> dict:
    """How sure the readers were, which shape raw lines' times have, and how much of the source no reader knew."""
    shapes = sorted({t["argument"].timestamp if t["reader"] == "inferred" else t["argument"] for t in told if t["reader"] in ("raw_lines", "inferred") and t["argument"]})
    raw = [t for t in told if t["reader"] == "raw_lines"]
    out = {"format": ",".join(sorted({t["reader"] for t in told})), "detect_confidence": round(max((t["confidence"] for t in told), default=0.0), 3)}
    if shapes:
        out |= {"timestamp_shape": ",".join(shapes), "timestamp_year_inferred": options.year is not None and "syslog" in shapes}
    if raw and options.reader is None:
        share = sum(t["bytes"] for t in raw) / max(1, sum(t["bytes"] for t in told))
        out |= {"fallback": "raw_lines", "fallback_share": round(share, 4), "fallback_reason": f"no reader knew {len(raw)} of {len(told)} files"}
    return out


@contextmanager
def _workplace(spark: SparkSession) -> Iterator[Callable[..., tuple[DataFrame, dict]]]:
    """Writes tables outside of any incident and removes them however the ingest ends: they hold what redaction takes out.

    What is written comes back with the aggregates ``seen`` of it, taken in the same pass.
    """
    root = scratch(spark)

    def written(df: DataFrame, name: str, *seen) -> tuple[DataFrame, dict]:
        watch = Observation(name)
        (df.observe(watch, *seen) if seen else df).write.option("compression", "zstd").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}"), watch.get if seen else {}

    try:
        yield written
    finally:
        Files(spark, root).delete(root)


def _salted(options: Options) -> Options:
    """A salt that isn't given is drawn for this ingest and stored nowhere."""
    return options if options.salt else replace(options, salt=secrets.token_hex(16))


def ingest(spark: SparkSession, source: str | Path, root: str | Path, incident: str | None = None, options: Options = Options()) -> Result:
    """Ingests ``source``; an earlier ingest of the same incident is replaced."""
    store, options = Store(spark, root, incident or incident_id(str(source))), _salted(options)
    with _workplace(spark) as written:
        told: list[dict] = []
        records, used, skipped = _read(spark, source, options, told)
        records, counters = written(records, "records", *R.counted())
        raw_reader = any(name == "raw_lines" for _, name in used)
        events, found = written(_redacted(files.number_events(records), options), "redacted", *_replacements(options))
        tallies = _tally(events, found, options)
        events = events.drop("redactions")

        masked = _masked(events, raw_reader)
        sim_th, status, cap, calibration = options.sim_th, "disabled", options.max_clusters, {}
        if options.calibrate:
            head = [r["message"] or "" for r in masked.orderBy("id").limit(drain.SAMPLE).collect()]
            found = drain.calibrate(head, depth=options.depth, max_clusters=UNCOMPRESSIBLE_CAP)
            status, sim_th = found["status"], found["sim_th"] or sim_th
            cap = min(cap, UNCOMPRESSIBLE_CAP) if status == "under_clustered" else cap
            calibration = {"calibration_lines": len(head), "calibration_templates": found["templates"]}
        tree = {"sim_th": sim_th, "depth": options.depth, "max_clusters": cap}
        found = drain.cluster_on(masked, None, **tree)
        store.replace("events", _labelled(events, found))
    store.replace("tree", drain.stamped(found.state, **tree))
    facts = {
        "ingest": {**counters, **_told(told, options), "files": len(used), "skipped_files": len(skipped), "raw_lines": raw_reader},
        "templating": {"status": status, "sim_th": sim_th, "depth": options.depth, "max_clusters": cap, "serial_token_counts": len(found.serial), **calibration},
    }
    store.create(str(source), ",".join(sorted({n for _, n in used})), "strict" if options.redact else "off", _brief(options))
    return _finished(store, options, counters, tallies, status, facts)


def extend(spark: SparkSession, source: str | Path, store: Store, options: Options = Options()) -> Result:
    """Adds the records of ``source`` behind an incident's events, as if both had been ingested together with this salt.

    Templates go on from the stored log of the tree; only where that is missing, damaged or of another version are
    the stored messages clustered again.
    """
    if not options.salt:
        raise ValueError("extending an incident needs the salt of its ingest")
    old, known = store.read("events"), store.metrics()
    last = old.agg(F.max("id")).first()[0] or 0
    with _workplace(spark) as written:
        records, used, skipped = _read(spark, source, options, [])
        records, new = written(records, "records", *R.counted())
        raw_reader = any(name == "raw_lines" for _, name in used)
        fresh = files.number_events(records).withColumn("id", F.col("id") + last)
        events, found = written(_redacted(fresh, options), "redacted", *_replacements(options))
        tallies = _tally(events, found, options)
        events = events.drop("redactions")
        try:
            stored = store.read("tree")
            made = stored.select("sim_th", "depth", "max_clusters").first()
        except Exception as e:  # no table, or no readable one
            if not isinstance(e, KeyError) and "pyspark" not in type(e).__module__ and "py4j" not in type(e).__module__:
                raise
            stored, made = None, None
        tree = made.asDict() if made else {"sim_th": float(known.get(("templating", "sim_th")) or options.sim_th), "depth": options.depth, "max_clusters": options.max_clusters}
        state, masked = drain.usable(stored, **tree), _masked(events, raw_reader)
        if state is not None:
            try:
                found = drain.cluster_on(masked, state, **tree)
            except drain.StartOver:
                state = None
        before = old.select("id", "template_id")
        if state is None:
            was_raw = known.get(("ingest", "raw_lines")) == "True"
            found = drain.cluster_on(_masked(old, was_raw).union(masked), None, **tree)
            before = found.lines.select("id", "template_id").where(F.col("id") <= last)
        # Templates of earlier events may have got wider: patterns come from the templates, not from what was stored.
        both = old.drop("template_id", "pattern").join(before, "id", "left").join(found.templates.select("template_id", "pattern"), "template_id", "left")
        both, _ = written(both.select(*old.columns).unionByName(_labelled(events, found).select(*old.columns)), "both")
        store.replace("events", both)
    store.replace("tree", drain.stamped(found.state, **tree))
    count = lambda name: int(float(known.get(("ingest", name)) or 0))
    counters = {name: n + count(name) for name, n in new.items()}
    tallies = {name: tallies.get(name, 0) + count(f"redacted_{name}") for name in {*tallies, *(m[9:] for s, m in known if s == "ingest" and m.startswith("redacted_"))}}
    facts = {"ingest": {**counters, "files": len(used) + count("files"), "skipped_files": len(skipped) + count("skipped_files"), "raw_lines": raw_reader or known.get(("ingest", "raw_lines")) == "True"}}
    return _finished(store, options, counters, tallies, known.get(("templating", "status")) or "disabled", facts | {"templating": {"resumed": state is not None}})


def _replacements(options: Options) -> list:
    """Aggregates over redacted events: replacements by entity."""
    return [F.sum(F.size(F.filter("redactions", lambda r: r["entity"] == e))).alias(e) for e in options.entities] if options.redact else []


def _tally(events: DataFrame, found: dict, options: Options) -> dict[str, int]:
    """Replacements by entity, of those that there were; the vault takes their values."""
    if options.vault:
        redaction.vault(events).write.mode("append").parquet(str(options.vault))
    return {e: n for e, n in found.items() if n}


def _labelled(events: DataFrame, found: drain.Clustered) -> DataFrame:
    return events.join(found.lines, "id", "left").select(
        "id", "ts", "source", "severity", "template_id", "pattern", "raw", "message", "fields", texts.trace_id(F.col("fields")).alias("trace_id"),
    )


def _finished(store: Store, options: Options, counters: dict, tallies: dict, status: str, facts: dict) -> Result:
    """Templates, scores, the signal set, the health report and the metrics over the stored events."""
    events = store.read("events")
    templates = A.template_summary(events)
    unmapped = counters["unmapped_severity"] / counters["records"] if counters["records"] else 1.0
    stats = A.burst_stats(events, templates).join(templates.select("template_id", "pattern"), "template_id")
    scores = scoring.score(stats, A.bucket_count(events), informative=unmapped <= UNINFORMATIVE)
    store.replace("templates", scoring.with_scores(templates, scores))
    templates = store.read("templates")
    store.replace("signal", scoring.signal_set(templates.select("template_id", F.col("anomaly_score").alias("score")), *options.signal))
    report = health.report(events, templates, counters | {"raw_lines": facts["ingest"]["raw_lines"]}, options.thresholds)
    store.record("ingest", facts["ingest"] | {"events_loaded": counters["records"]} | {f"redacted_{k}": v for k, v in tallies.items()})
    store.record("redaction", _redaction_facts(store.spark, tallies, options))
    store.record("templating", facts["templating"] | _template_facts(templates, counters))
    store.record("anomaly", _anomaly_facts(store, templates, unmapped, options))
    store.record("health", {**report.metrics, "verdict": report.verdict, **{f"check_{name}": status for name, status, _ in report.checks}})
    return Result(store, counters, report, tallies, status)


def _redaction_facts(spark: SparkSession, tallies: dict, options: Options) -> dict:
    out = {"mode": "strict" if options.redact else "off", "entities": ",".join(options.entities), "total": sum(tallies.values()), "vault": bool(options.vault)}
    if options.vault:
        out |= {"vault_path": str(options.vault), "vault_entries": spark.read.parquet(str(options.vault)).select("token").distinct().count()}
    return out


def _template_facts(templates: DataFrame, counters: dict) -> dict:
    """One aggregate over the templates, and the over-merged ones (their number, and the first MOST_IDS of their ids)."""
    r = templates.agg(F.count("*").alias("n"), F.coalesce(F.sum("occurrence_count"), F.lit(0)).alias("events"), F.coalesce(F.max("occurrence_count"), F.lit(0)).alias("most")).first()
    merged = A.over_merged(templates)
    ids = [x["template_id"] for x in merged.orderBy("template_id").limit(MOST_IDS).collect()]
    out = {
        "templates": r["n"], "coverage": round(r["events"] / counters["records"], 6) if counters["records"] else 1.0, "events_per_template": round(r["events"] / r["n"], 2) if r["n"] else 0.0,
        "largest_share": round(r["most"] / r["events"], 4) if r["events"] else 0.0, "compression_ratio": round(r["n"] / counters["lines_read"], 5) if counters["lines_read"] else 0.0,
        "over_merged": merged.count(),
    }
    return out | ({"over_merged_ids": ",".join(map(str, ids))} if ids else {})


def _anomaly_facts(store: Store, templates: DataFrame, unmapped: float, options: Options) -> dict:
    scores = templates.select("template_id", F.col("anomaly_score").alias("score"))
    signal = [r["template_id"] for r in store.read("signal").orderBy("rank").collect()]  # signal[1] rows at most
    top = scores.orderBy(F.desc("score"), "template_id").first()
    needle = scoring.needle_position(scores, templates).first()
    out = {
        "severity_informative": unmapped <= UNINFORMATIVE, "unmapped_severity_share": round(unmapped, 4), "signal_templates": len(signal), "signal_template_ids": ",".join(map(str, signal)),
        "suppressed_noise": reads.noise_templates(templates, reads.Noise()).count(), "weights": ",".join(f"{k} {v}" for k, v in scoring.WEIGHTS.items()),
    }
    return out | ({"top_template_id": top["template_id"], "top_score": round(top["score"], 4), "needle_position": needle["rank"]} if top else {})
