"""The whole ingest over a planted incident."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from incidentlens.operators import health
from incidentlens.plans.ingest import Options, ingest
from incidentlens.sources import generator


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("incident")
    generator.write(generator.incident(2000), folder / "checkout.jsonl")
    return ingest(spark, folder / "checkout.jsonl", folder / "store", "planted", Options(salt="s", vault=str(folder / "vault")))


def test_counts(planted):
    n = len(generator.incident(2000))
    assert planted.counters == {"lines_read": n, "records": n, "parse_errors": 0, "unmapped_severity": 0}
    assert planted.store.read("templates").count() == 9
    assert planted.store.read("events").where("template_id is null").count() == 0


def test_the_cause_leads(planted):
    top = planted.store.read("signal").orderBy("rank").first()
    pattern = planted.store.read("templates").where(F.col("template_id") == top["template_id"]).first()["pattern"]
    assert pattern.startswith(generator.CAUSE)


def test_nothing_planted_survives_redaction(planted):
    text = " ".join(f"{r['raw']} {r['message']} {r['fields']}" for r in planted.store.read("events").collect())
    for secret in (*generator.EMAILS, *generator.ADDRESSES, generator.API_KEY):
        assert secret not in text
    assert planted.redactions["api_key"] > 0 and planted.redactions["email"] > 0 and planted.redactions["ipv4"] > 0
    assert not {"records", "redacted"} & set(planted.store.files.names(planted.store.folder))


def test_vault_reveals_by_token(spark, planted):
    from incidentlens.operators import redaction

    vault = spark.read.parquet(f"{planted.store.root}/../vault")
    token = redaction.Redactor("s").token("api_key", generator.API_KEY)
    assert redaction.reveal(vault, token).first()["value"] == generator.API_KEY
    with pytest.raises(ValueError):
        redaction.reveal(vault)


def test_health_of_a_good_log(planted):
    names = [c[0] for c in planted.report.checks]
    assert len(names) == 12 and planted.report.verdict in (health.OK, health.WARN)


def test_quiet_hour_and_formats_in_a_folder(spark, tmp_path):
    logs = tmp_path / "logs"
    (logs / ".git").mkdir(parents=True)
    (logs / ".git" / "x.jsonl").write_text("{}")
    quiet = generator.quiet_hour(300)
    with gzip.open(logs / "a.data", "wt") as f:
        f.writelines(json.dumps({k: v for k, v in r.items() if k != "service"}) + "\n" for r in quiet)
    (logs / "b.log").write_text("\n".join(f"{r['timestamp']} {r['level']} {r['message']}" for r in quiet[:50]))
    (logs / "c.otlp").write_text("\n".join(generator.as_otlp(quiet[:100])))
    (logs / "d.png").write_bytes(b"\x89PNG\r\n\x1a\n\0")
    got = ingest(spark, logs, tmp_path / "store", "quiet", Options(calibrate=False))
    assert got.counters["records"] == 450
    sources = {r["source"] for r in got.store.read("events").select("source").distinct().collect()}
    assert {"a", "b"} < sources and set(generator.SERVICES) <= sources
    assert got.store.metrics()["ingest", "skipped_files"] == "1"
    assert got.store.read("templates").agg(F.max("max_severity_rank")).first()[0] == 3


@pytest.mark.parametrize("style", ["naive", "explicit"])
def test_mixed_zones(spark, tmp_path, style):
    for name, records in generator.mixed_zones(1500, style=style).items():
        generator.write(records, tmp_path / f"{name}.jsonl")
    got = ingest(spark, tmp_path, tmp_path.parent / f"store-{style}", "zones", Options(calibrate=False))
    status = {name: s for name, s, _ in got.report.checks}["timezones"]
    assert status == (health.FAIL if style == "naive" else health.OK)
