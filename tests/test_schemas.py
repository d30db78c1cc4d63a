"""The schema store on the ingest path, quoted fields, schemas for a part of a file, and the stages' metrics."""

import json

import pytest

from incidentlens.agent.provider import Scripted, Turn
from incidentlens.plans import ingest as I
from incidentlens.sources import bootstrap, files

GOOD = [f"2026-08-30 14:00:{i:02d} [ERROR] svc: failed {i}" for i in range(40)]


def test_a_second_ingest_reads_the_stored_schema(spark, tmp_path, monkeypatch):
    log, schemas = tmp_path / "a.log", tmp_path / "schemas"
    log.write_text("\n".join(f"<2026-08-30 14:00:{i % 60:02d}> ERROR svc[{i}]: failed {i}" for i in range(300)))
    options = I.Options(bootstrap=True, schemas=str(schemas), calibrate=False, salt="s")
    first = I.ingest(spark, log, tmp_path / "root", "a", options)
    stored = list(schemas.glob("*.json"))
    assert len(stored) == 1 and first.store.metrics()["ingest", "format"] == "inferred"
    monkeypatch.setattr(bootstrap, "infer", lambda *_, **__: None)  # only the store is left
    told = []
    files.read_source(spark, str(log), allow_bootstrap=True, schemas=str(schemas), told=told)
    assert told[0]["reader"] == "inferred" and told[0]["argument"].origin.startswith("stored:") and told[0]["confidence"] == 1.0
    second = I.ingest(spark, log, tmp_path / "root", "b", options)
    assert second.counters == first.counters and [p.read_text() for p in schemas.glob("*.json")] == [json.dumps(json.loads(stored[0].read_text()), sort_keys=True)]


def test_stored_and_inferred_schemas_are_ranked_together(spark, tmp_path):
    thin, rich = bootstrap.LineSchema("iso8601", False, False), bootstrap.LineSchema("iso8601", True, True)
    for s in (thin, rich):
        bootstrap.save(spark, s, tmp_path)
    (tmp_path / "zz.json").write_text('{"timestamp": "nonsense"}')
    known = bootstrap.load(spark, tmp_path)
    assert len(known) == 2 and all(k.origin.startswith("stored:") for k in known)
    found = bootstrap.bootstrap(GOOD[:20], GOOD[20:], known)
    assert (found.has_severity, found.has_source) == (True, True)
    assert bootstrap.bootstrap(GOOD[:20], [], known).origin.endswith(":sample")
    assert bootstrap.load(spark, tmp_path / "none") == []


@pytest.mark.parametrize(("quote", "want"), [
    (("2026-08-30 14:00:01", "[ERROR]", "failed 1"), ("iso8601", True, True)), (("2026-08-30 14:00:01", "", "failed 1"), ("iso8601", False, True)),
    (("2026-08-30 14:00:02", "[ERROR]", "failed 1"), None), (("2026-08-30 14:00:01", "[FATAL]", "failed 1"), None), (("2026-08-30 14:00:01", "svc", "failed 1"), None),
    (("2026-08-30 14:00:01", "[ERROR]", "it failed"), None), (("failed", "", ""), None), (("", "", ""), None),
])
def test_invented_quotes_are_dropped(quote, want):
    assert bootstrap.quoted_reading(GOOD[1], *quote) == want


def test_a_client_is_asked_only_where_inference_fails(monkeypatch):
    asked = Scripted([])
    assert bootstrap.bootstrap(GOOD[:20], GOOD[20:], provider=asked) and not asked.seen
    monkeypatch.setattr(bootstrap, "infer", lambda *_, **__: None)
    quotes = [{"n": i + 1, "timestamp": line[:19], "severity": "[ERROR]", "message": line.split(": ", 1)[1]} for i, line in enumerate(GOOD[:1])]
    noise = [{"n": 1, "timestamp": "yesterday", "severity": "", "message": ""}, {"n": 99, "timestamp": "x"}, {"n": "no"}]
    for answer, works in ((json.dumps({"lines": quotes + noise}), True), ("```json\n" + json.dumps({"lines": quotes}) + "\n```", True), ("not JSON", False), ('{"lines": 3}', False), ("[]", False), ('{"lines": []}', False)):
        client = Scripted([Turn(text=answer)])
        found = bootstrap.bootstrap(GOOD[:20], GOOD[20:], provider=client)
        assert (found is not None) == works and len(client.seen) == 1
        assert not works or (found.origin == "quoted" and found.rate == 1.0)


def test_a_part_of_a_mixed_file_is_better_than_nothing():
    mixed = [line for i, g in enumerate(GOOD) for line in (g, f"    at module.function({i})", "    caused by nothing")]
    found = bootstrap.bootstrap(mixed[:60], mixed[60:])
    assert found.origin == "part" and found.timestamp == "iso8601" and found.rate == 1.0
    assert bootstrap.bootstrap(["no time", "none here"] * 10, []) is None


def test_stage_metrics_come_from_the_passes_that_write(spark, tmp_path, monkeypatch):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text("".join(json.dumps({"ts": f"2024-01-01T00:{i:02d}:00Z", "level": "ERROR" if i % 9 == 0 else "odd", "message": f"user bob@x.org did thing {i}"}) + "\n" for i in range(40)) + "{broken\n")
    (logs / "b.log").write_text("".join(f"2024-01-01 00:00:{i:02d} plain text {i}\n" for i in range(20)))
    scans = []
    counters = I.R.counters
    monkeypatch.setattr(I.R, "counters", lambda df: scans.append(1) or counters(df))
    got = I.ingest(spark, logs, tmp_path, "i", I.Options(salt="s", vault=str(tmp_path / "vault"), calibrate=False))
    m = {k: v for k, v in got.store.metrics().items()}
    assert not scans and got.counters == {"lines_read": 61, "records": 60, "parse_errors": 1, "unmapped_severity": 55}
    assert m["ingest", "format"] == "json_lines,raw_lines" and m["ingest", "fallback"] == "raw_lines" and 0 < float(m["ingest", "fallback_share"]) < 0.5
    assert m["ingest", "timestamp_shape"] == "iso8601" and m["ingest", "fallback_reason"] == "no reader knew 1 of 2 files"
    assert got.redactions == {"email": 80}
    assert m["redaction", "total"] == str(sum(got.redactions.values())) and m["redaction", "vault_entries"] == "1" and m["redaction", "mode"] == "strict"
    assert m["templating", "coverage"] == "1.0" and m["templating", "templates"] == str(got.store.read("templates").count())
    assert int(m["anomaly", "signal_templates"]) == got.store.read("signal").count() and int(m["anomaly", "needle_position"]) >= 1
    from incidentlens.plans import report

    assert any("No reader knew" in w for w in report.collect(got.store)["warnings"])


def test_many_files_are_looked_at_by_tasks(spark, tmp_path, monkeypatch):
    for i in range(90):
        folder = tmp_path / f"d{i % 7}"
        folder.mkdir(exist_ok=True)
        if i % 3 == 0:
            (folder / f"{i}.jsonl").write_text(json.dumps({"ts": "2024-01-01T00:00:00Z", "message": f"m{i}"}) + "\n")
        elif i % 3 == 1:
            (folder / f"{i}.log").write_text(f"2024-01-01 00:00:00 plain {i}\n" * (40_000 if i == 40 else 1))
        else:
            (folder / f"{i}.bin").write_bytes(b"\x7fELF" + bytes(10))
    (tmp_path / "d1" / "venv").mkdir()
    (tmp_path / "d1" / "venv" / "x.log").write_text("no")
    one_by_one = []
    head = files.read_head
    monkeypatch.setattr(files, "read_head", lambda s, p, n: one_by_one.append(str(p)) or head(s, p, n))
    told = []
    records, used, skipped = files.read_source(spark, str(tmp_path), told=told)
    looked = [p for p in one_by_one if p.endswith("/40.log")]
    assert len(used) == 60 and len(skipped) == 30 and all("program" in s for s in skipped) and looked and len(set(one_by_one)) < 10
    assert {t["reader"] for t in told} == {"json_lines", "raw_lines"} and records.count() == 59 + 40_000
    monkeypatch.setattr(files, "FEW", 1000)
    again = files.read_source(spark, str(tmp_path))
    assert (again[1], again[2]) == (used, skipped)


def test_blank_files_beside_others_are_no_fallback(spark, tmp_path):
    """A writer leaves an empty file for a partition without rows; nobody could tell its format, and it holds no record."""
    import bz2
    import gzip

    from incidentlens.sources import files

    line = '{"ts": "2026-01-01T00:00:00Z", "level": "INFO", "service": "a", "msg": "m"}\n'
    (tmp_path / "a.jsonl").write_text(line)
    (tmp_path / "b.jsonl").write_text("")
    (tmp_path / "c.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "d.bz2").write_bytes(bz2.compress(b" \n"))
    (tmp_path / "e.gz").write_bytes(gzip.compress(b"") + gzip.compress(line.encode()))  # text behind an empty stream
    told = []
    records, used, skipped = files.read_source(spark, tmp_path, told=told)
    assert [path.rsplit("/", 1)[1] for path, _ in used] == ["a.jsonl", "e.gz"] and skipped == [] and len(told) == 2
    assert records.where("status = 'ok'").count() == 2
    (tmp_path / "a.jsonl").unlink()
    (tmp_path / "e.gz").unlink()
    assert files.read_source(spark, tmp_path)[0].count() == 0  # blank files alone are a log without records


def test_detection_of_a_folder_passes_over_its_empty_files(spark, tmp_path, monkeypatch):
    from incidentlens.plans import catalog
    from incidentlens.plans import views as V

    monkeypatch.setattr(V, "log_events", lambda s, d: s.sql(
        "select id, timestamp'2026-01-01' as ts, concat('svc-', id % 4) as source, 'INFO' as severity, 'm' as message, 't' as trace_id from range(-40, 40, 1, 4) where id >= 0"
    ))  # its first partition has no row
    got = sorted(map(tuple, catalog.queries()["folder_detection"](spark, "").collect()))
    assert got == [(f"svc-{i}", "json_lines", 3) for i in range(4)]


def test_lines_are_numbered_where_they_are(spark, tmp_path):
    """Splits of a few bytes, files of all lengths: numbers are places, and no line is dealt or sorted for them."""
    from incidentlens.sources import records as R

    texts = {f"f{i}.log": [f"{i} line {j}" + "x" * (j % 7) for j in range(i * 13)] for i in range(1, 6)}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        df = R.read_lines(spark, str(tmp_path))
        got = {(r["source_file"].rsplit("/", 1)[1], r["line_no"]): r["line"] for r in df.collect()}
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(name, i): line for name, lines in texts.items() for i, line in enumerate(lines, 1)}
    assert "row_number" not in plan


def test_events_are_numbered_past_gaps_and_repeats(spark):
    """Whole blocks, blocks with missing lines, lines of several records, and as many records as the span of their lines has lines."""
    from incidentlens.sources import files

    rows = [("a", n, "x", "ok") for n in range(1, 40_001)] + [("b", n, "x", "error" if n % 3 == 0 else "ok") for n in range(1, 50)]
    rows += [("c", 1, "p", "ok"), ("c", 1, "q", "ok"), ("c", 3, "r", "ok"), (None, 1, "y", "ok"), (None, 2, "z", "ok")]
    df = spark.createDataFrame(rows, "source_file string, line_no long, raw string, status string").repartition(5)
    want = sorted((r for r in rows if r[3] == "ok"), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    got = sorted((r["id"], r["source_file"], r["line_no"], r["raw"]) for r in files.number_events(df).collect())
    assert got == [(i, *r[:3]) for i, r in enumerate(want, 1)]


def test_json_values_with_and_without_escapes(spark):
    import json

    from incidentlens.sources import readers

    texts = ["plain", "", "a\"b", "back\\slash", "tab\tnew\nline", "ümläut", "null", '"quoted"']
    rows = [("f", i, json.dumps({"ts": "2026-01-01T00:00:00Z", "level": "warn", "service": t, "message": None, "msg": t, "k": {"v": t}})) for i, t in enumerate(texts)]
    rows += [("f", 90, '{"ts": "2026-01-01T00:00:00Z", "msg": 5, "level": null, "lvl": "err"}'), ("f", 91, "{broken"), ("f", 92, '{"msg": "no time"}')]
    got = {r["line_no"]: r for r in readers.json_lines(spark.createDataFrame(rows, "source_file string, line_no long, line string")).collect()}
    for i, t in enumerate(texts):
        fields = {"k": {"v": t}, "message": None}
        assert (got[i]["message"], got[i]["source"], got[i]["severity"], json.loads(got[i]["fields"]), got[i]["status"]) == (t, t.strip() or None, "WARN", fields, "ok")
    assert (got[90]["message"], got[90]["severity"], got[90]["source"]) == ("5", "ERROR", None) and json.loads(got[90]["fields"]) == {"level": None}
    assert [got[i]["status"] for i in (91, 92)] == ["error", "error"] and got[91]["message"] == "{broken" and got[92]["message"] == "no time"


def test_redaction_holds_a_bounded_piece_of_text():
    import pyarrow as pa

    from incidentlens.operators import redaction

    texts = ["a" * n for n in (10, 900, 200, 5000, 0, 300, 700)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["id", "message"])
    got = list(redaction.pieces(batch, ["message"], 1000))
    assert [p.column(0).to_pylist() for p in got] == [[0, 1], [2], [3, 4][:1], [4, 5, 6, 7]]
    assert [t for p in got for t in p.column(1).to_pylist()] == texts
