"""Tables with a log of commits, the layout of events, and ingests that leave nothing in clear."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from incidentlens.operators import commits, ranks, reads
from incidentlens.operators.commits import Files, Table
from incidentlens.operators.store import Store
from incidentlens.plans import ingest as I
from incidentlens.sources import generator

NOTE = {"step": 1, "note": "x", "confidence": "low", "template_ids": [1]}


def test_two_writers_lose_no_note(spark, tmp_path):
    """Two stores of one incident, on a path without a scheme, writing at once."""
    failed = []

    def write(k):
        try:
            for i in range(5):
                Store(spark, str(tmp_path), "i").write_note(NOTE | {"note": f"{k}-{i}"})
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    rows = Store(spark, str(tmp_path), "i").read("notes").collect()
    assert not failed and sorted(r["note_id"] for r in rows) == list(range(1, 11))
    assert {r["note"] for r in rows} == {f"{k}-{i}" for k in range(2) for i in range(5)}


def test_a_lost_race_starts_over_with_the_newer_version(spark, tmp_path):
    table = Table(spark, Files(spark, str(tmp_path)), "t")
    one = lambda i: spark.createDataFrame([(i,)], "i int")
    table.replace(one(1))
    seen = []

    def rows(before):
        seen.append(sorted(r["i"] for r in before.collect()))
        if len(seen) == 1:
            Table(spark, Files(spark, str(tmp_path)), "t").append(lambda _: one(2))  # somebody is faster
        return one(3)

    table.append(rows)
    assert seen == [[1], [1, 2]] and sorted(r["i"] for r in table.read().collect()) == [1, 2, 3]
    parts = [n for n in table.files.names(table.files.at("t")) if n.startswith("part-")]
    assert sorted(parts) == sorted(table.latest()[1]["parts"])  # the loser's part is gone


def test_numbers_are_taken_once(spark, tmp_path):
    files = Files(spark, str(tmp_path / "d"))
    path = files.at("x", "1.json")
    assert files.create(path, "a") and not files.create(path, "b") and files.read(path) == "a"
    assert files.names(files.at("x")) == ["1.json"]
    files.local = False  # by rename, as on HDFS
    assert not files.create(path, "c") and files.create(files.at("x", "2.json"), "d") and files.names(files.at("x")) == ["1.json", "2.json"]


def test_old_versions_go_and_readers_keep_theirs(spark, tmp_path):
    table = Table(spark, Files(spark, str(tmp_path)), "t")
    table.replace(spark.range(3))
    reader = table.read()
    table.replace(spark.range(5))
    assert reader.count() == 3 and table.read().count() == 5
    for n in range(6):
        table.replace(spark.range(n))
    assert len([n for n in table.files.names(table.files.at("t")) if n.startswith("part-")]) == commits.KEEP
    assert len(table.files.names(table.log)) == commits.KEEP
    for _ in range(commits.MOST_PARTS + 2):
        table.append(lambda _: spark.range(1))
    assert table.read().count() == 5 + commits.MOST_PARTS + 2 and len(table.latest()[1]["parts"]) <= commits.MOST_PARTS


def test_version_one_is_taken_over(spark, tmp_path):
    folder = tmp_path / "old"
    spark.createDataFrame([(1, 1, "n", [1], [], "low", "finding", False)], "note_id long, step long, note string, template_ids array<long>, log_event_ids array<long>, confidence string, role string, synthesis boolean").write.parquet(str(folder / "notes-abc"))
    rows = [(i, f"2024-01-01 00:00:{i:02d}", "s", "INFO", 1, "p", "r", "m", "{}", None) for i in range(5)]
    events = spark.createDataFrame(rows, "id long, ts string, source string, severity string, template_id long, pattern string, raw string, message string, fields string, trace_id string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(folder / "events-def"))
    for name, part in (("notes", "notes-abc"), ("events", "events-def")):
        (folder / f"{name}.json").write_text(json.dumps({"path": part, "schema_version": 1}))
    store = Store(spark, tmp_path, "old")
    assert store.write_note(NOTE) == 2 and store.read("notes").count() == 2
    assert store.slice(start="2024-01-01 00:00:02").count() == 3 and store.read("events").columns == events.columns
    assert not list(folder.glob("*.json"))
    store.replace("events", store.read("events"))
    assert store.read("events").count() == 5


def events(spark, n=4000):
    e = spark.range(n).selectExpr("id", "timestamp_seconds(1704067200 + id * 600) as ts", "concat('s', id % 3) as source", "if(id % 50 = 0, 'ERROR', 'INFO') as severity", "id % 7 as template_id", "concat('m ', id) as message")
    return e.withColumn("raw", F.when(F.col("id") % 2 == 0, F.col("message")).when(F.col("id") % 3 == 0, F.lit("other"))).withColumn("trace_id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), (F.col("id") / 40).cast("int"))))


def test_slices_read_the_folders_of_their_slots(spark, tmp_path):
    store = Store(spark, tmp_path, "i")
    given = events(spark)
    given = given.withColumn("ts", F.when(F.col("id") == 17, None).otherwise(F.col("ts")))
    store.write_events(given, slot_rows=5)
    assert sorted(map(str, store.read("events").select(*given.columns).collect())) == sorted(map(str, given.collect()))
    everything = len(store.events().inputFiles())
    assert everything > 100 and store.size() < 20_000 * everything  # filters are sized by what a slot holds
    window = {"start": "2024-01-05 03:10:00", "end": "2024-01-05 09:00:00"}
    for where in (window, window | {"severity": "ERROR"}, {"trace_id": "t31"}, {"trace_id": "nobody"}, {"start": "2024-01-27 20:00:00"}):
        want = given.where(F.expr(" and ".join([f"ts >= '{v}'" if k == "start" else f"ts <= '{v}'" if k == "end" else f"{k} = '{v}'" for k, v in where.items()])))
        found = store.slice(**where)
        assert [r["id"] for r in found.collect()] == [r["id"] for r in want.orderBy("ts", "id").collect()], where
        assert scanned(reads.matching(store.events(where.get("trace_id")), **where)) <= everything / 10, where
        assert store.slice_count(**where).first()["n"] == want.count()
    assert [r["id"] for r in store.slice(limit=3, severity="ERROR").collect()] == [0, 50, 100]


def scanned(df):
    """Files that the scan of a plan without a shuffle has opened."""
    df.collect()
    metrics = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
    return metrics.apply("numFiles").value() if metrics.contains("numFiles") else 0


def test_slots_fit_the_data(spark, tmp_path):
    store = Store(spark, tmp_path, "i")
    store.write_events(events(spark))
    assert {r[0] for r in store.events().select(F.length("slot")).distinct().collect()} == {7}
    store.write_events(events(spark), slot_rows=500)
    assert {r[0] for r in store.events().select(F.length("slot")).distinct().collect()} == {7}
    store.write_events(events(spark), slot_rows=100)
    assert {r[0] for r in store.events().select(F.length("slot")).distinct().collect()} == {10}
    store.write_events(events(spark).limit(0))
    assert store.slice().collect() == []


# ---- ingests


def clear_text(folder, *values):
    return [p for p in folder.rglob("*") if p.is_file() and any(v.encode() in p.read_bytes() for v in values)]


def plain_tables(spark, folder, *values):
    """Columns hold values compressed: reads every table below as text."""
    held = []
    for part in {p.parent for p in folder.rglob("*.parquet") if "slot=" not in str(p) and "bucket=" not in str(p)} | {p for p in folder.rglob("part-*") if p.is_dir() and any(p.rglob("*.parquet"))}:
        text = " ".join(str(r) for r in spark.read.parquet(str(part)).collect())
        held += [part for v in values if v in text]
    return held


SECRETS = ("bob@x.org", "Hunter2!x")


def test_brief_is_redacted_and_a_failed_ingest_leaves_nothing(spark, tmp_path, monkeypatch):
    for module in (I, ranks):
        monkeypatch.setattr(module, "scratch", lambda _: f"{tmp_path}/shared/{random.random()}")
    log = tmp_path / "a.jsonl"
    log.write_text("".join(json.dumps({"ts": f"2024-01-01T00:00:{i % 60:02d}Z", "level": "INFO", "message": f"user bob@x.org password: Hunter2!x try {i}"}) + "\n" for i in range(50)))
    options = I.Options(salt="s", brief="mail bob@x.org password: Hunter2!x", calibrate=False)
    got = I.ingest(spark, log, tmp_path / "root", "i", options)
    brief = got.store.row()["brief"]
    assert all(v not in brief for v in SECRETS) and "EMAIL" in brief.upper()

    def crash(*_, **__):
        assert plain_tables(spark, tmp_path / "shared", *SECRETS)  # there is something to clear
        raise RuntimeError("lost")

    monkeypatch.setattr(I.drain, "cluster_on", crash)
    with pytest.raises(RuntimeError):
        I.ingest(spark, log, tmp_path / "root", "j", options)
    for folder in (tmp_path / "root", tmp_path / "shared"):
        assert not plain_tables(spark, folder, *SECRETS) and not clear_text(folder, *SECRETS)


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """Two files and a folder with both."""
    folder = tmp_path_factory.mktemp("logs")
    records = generator.incident(900)
    random.Random(1).shuffle(records)
    both = folder / "both"
    both.mkdir()
    for name, part in (("a", records[:500]), ("b", records[500:])):
        generator.write(part, folder / f"{name}.jsonl")
        generator.write(part, both / f"{name}.jsonl")
    return folder


@pytest.mark.parametrize("damage", [None, "drop", "truncate"])
def test_ingest_then_extend_equals_both_at_once(spark, halves, tmp_path, damage):
    options = I.Options(salt="s", calibrate=False)
    whole = I.ingest(spark, halves / "both", tmp_path, "whole", options)
    first = I.ingest(spark, halves / "a.jsonl", tmp_path, "parts", options)
    if damage == "drop":
        first.store.drop("tree")
    elif damage:
        for part in (tmp_path / "parts" / "tree").rglob("*.parquet"):
            part.write_bytes(b"damaged")
            (part.parent / f".{part.name}.crc").unlink()
    both = I.extend(spark, halves / "b.jsonl", first.store, options)
    assert both.store.metrics()["templating", "resumed"] == str(damage is None)
    for name in ("events", "templates", "signal"):
        want, got = ([str(r) for r in s.read(name).orderBy(s.read(name).columns[0]).collect()] for s in (whole.store, both.store))
        assert got == want, name
    assert both.counters == whole.counters and both.redactions == whole.redactions
    with pytest.raises(ValueError):
        I.extend(spark, halves / "b.jsonl", first.store)


def test_common_log_format_on_the_ingest_path(spark, tmp_path):
    log = tmp_path / "access.log"
    log.write_text("".join(f'10.0.0.{i} - - [10/Oct/2023:13:55:{i:02d} -0700] "GET /x HTTP/1.0" 200 {i}\n' for i in range(30)))
    got = I.ingest(spark, log, tmp_path, "i", I.Options(calibrate=False, clf=True, redact=False))
    assert got.store.read("events").agg(F.min("ts").cast("string")).first()[0].startswith("2023-10-10 20:55:00")


def test_stored_cleared_gives_what_its_sql_says(spark):
    """Notes and queries of three templates, one objection and one critique; nothing is left."""
    from incidentlens.plans import catalog

    rows = catalog.queries()["stored_cleared"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, rows)) == [("critique", 1, 0), ("notes", 3, 0), ("objections", 1, 0), ("query_log", 3, 0)]
