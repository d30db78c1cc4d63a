"""Many markers in one scan, ranks without one task, values of any depth, and a query's deadline."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from incidentlens.operators import scoring, search
from incidentlens.plans import guard
from incidentlens.sources import readers


def test_ten_thousand_markers_in_one_scan(spark):
    rng = random.Random(1)
    words = ["alpha", "Beta", "é", "É", "k=7", "x", ""]
    texts = [(i % 13, " ".join(rng.choice(words) for _ in range(6))) for i in range(300)] + [(3, None), (None, "alpha")]
    markers = list({" ".join(rng.choice([w.upper() if w.isascii() else w for w in words]) for _ in range(rng.randint(1, 4))) for _ in range(800)}) + [f"nowhere {i}" for i in range(10_000)] + ["", "É x", None, "alpha", "ALPHA"]
    fold = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    want = {(m, k) for m in markers if m is not None for k, t in texts if k is not None and t is not None and fold(m) in fold(t)}
    rows, names = spark.createDataFrame(texts, "template_id long, message string"), spark.createDataFrame([(m,) for m in markers], "marker string")
    found = search.holders(rows, names, "template_id")
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_markers_over_several_scans(spark, monkeypatch):
    monkeypatch.setattr(search, "CHUNK", 3)
    monkeypatch.setattr(search, "CHUNK_BYTES", 10)
    rows = spark.createDataFrame([(1, "abcdefgh"), (2, "xyz")], "template_id long, message string")
    names = spark.createDataFrame([(m,) for m in ("abc", "CDEFGH", "bcdefg", "x", "yz", "nothing here", "q")], "marker string")
    assert {tuple(r) for r in search.holders(rows, names, "template_id").collect()} == {("abc", 1), ("CDEFGH", 1), ("bcdefg", 1), ("x", 2), ("yz", 2)}
    assert search.holders(rows, names.limit(0), "template_id").collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_signal_set_against_lists(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0.1, 0.2, 0.5, 0.51, 0.9])) for i in range(rng.randrange(25))]
    least, most = rng.choice([(1, 1), (2, 5), (3, 15), (3, 3)])
    top = sorted(rows, key=lambda r: (-r[1], r[0]))
    places = [p for p in range(least, most) if p < len(top)]
    cut = max(places, key=lambda p: (top[p - 1][1] - top[p][1], -p)) if places else min(len(top), most)
    frame = spark.createDataFrame(rows, "template_id long, score double")
    got = scoring.signal_set(frame, least, most)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(*r, i + 1) for i, r in enumerate(top[:cut])]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r["template_id"], r["rank"]) for r in scoring.ranked(frame).orderBy("rank").collect()] == [(r[0], i + 1) for i, r in enumerate(top)]
    if rows:
        worst = spark.createDataFrame([(i, i % 3) for i, _ in rows], "template_id long, max_severity_rank int")
        needle = min(rows, key=lambda r: (-(r[0] % 3), r[0]))
        assert tuple(scoring.needle_position(frame, worst).first()) == (needle[0], top.index(needle) + 1)


def nest(depth, kind=0):
    if depth == 0:
        return {"intValue": "7"}
    inner = nest(depth - 1, kind + 1)
    return {"arrayValue": {"values": [inner, {"stringValue": f'q"{depth}'}, {}]}} if kind % 2 else {"kvlist_value": {"values": [{"key": f"k{depth}", "value": inner}, {"key": "b", "value": {"boolValue": True}}, {"key": "e", "value": {}}]}}


def test_values_of_any_depth(spark):
    lines = [json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "1756476000000000000", "body": nest(d), "attributes": [{"key": "deep", "value": nest(d, 1)}, {"key": "flat", "value": {"stringValue": "s"}}, {"key": "deep", "value": nest(d)}, {"value": nest(1)}]}]}]}]}) for d in (1, 3, 8, 20)]
    df = spark.createDataFrame([("f", i, line) for i, line in enumerate(lines)], "source_file string, line_no long, line string")
    for r, d in zip(readers.otlp(df).orderBy("line_no").collect(), (1, 3, 8, 20), strict=True):
        assert json.loads(r["message"]) == readers.untagged(nest(d)) and "Value" not in r["message"] + r["fields"] and "_value" not in r["message"]
        fields = json.loads(r["fields"])
        assert json.loads(fields["deep"]) == readers.untagged(nest(d)) and fields["flat"] == "s"
    value = {"arrayValue": {"values": [{"intValue": "x"}, {"arrayValue": {}}, {"kvlistValue": None}, {"odd": 1}, "bare", {"doubleValue": 1.5}]}}
    assert readers.untagged(value) == ["x", [], {}, {"odd": 1}, "bare", 1.5]


def test_objects_flatten_at_any_depth(spark):
    doc = {"@timestamp": "2024-01-01T00:00:00Z", "message": "m", "a": {"b": {"c": {"d": {"e": {"f": 1, "g": [1, {"x": 2}], "none": {}}}}}}, "log": {"level": "INFO"}, "shallow": {"k": "v"}}
    plain = {k: v for k, v in doc.items() if k != "a"}
    df = spark.createDataFrame([("f", i, json.dumps(x)) for i, x in enumerate((doc, plain))], "source_file string, line_no long, line string")
    deep, flat = (json.loads(r["fields"]) for r in readers.elastic(df).orderBy("line_no").collect())
    assert deep == {"a.b.c.d.e.f": 1, "a.b.c.d.e.g": [1, {"x": 2}], "shallow.k": "v"} and flat == {"shallow.k": "v"}


def test_a_query_past_its_deadline_is_stopped(spark):
    views = {"log_events": spark.range(40_000).selectExpr("id", "concat('m', id) as message")}
    began = time.time()
    with pytest.raises(guard.ReadOnlyViolation, match="stopped after 2 seconds"):
        guard.run_readonly(spark, "SELECT sum(length(concat(a.message, b.message))) FROM log_events a, log_events b", views, time_limit=2)
    assert time.time() - began < 30
    # Tasks end at their next batch of rows; then the slots are free again.
    assert guard.run_readonly(spark, "SELECT count(*) AS n FROM log_events", views, time_limit=120).first()["n"] == 40_000
    with pytest.raises(guard.ReadOnlyViolation):
        guard.run_readonly(spark, "SELECT id / 0 AS x FROM log_events WHERE raise_error(message) IS NULL", views, time_limit=120)
    assert spark.range(5).count() == 5
