import json

from incidentlens.operators import truth


def test_signals_that_can_be_looked_for(spark):
    signals = [
        {"type": "error", "importance": "critical", "value": "  connection pool exhausted "}, {"type": "stack_location", "importance": "critical", "file": "src/pool/acquire.rs:41", "value": ""},
        {"type": "exit_code", "importance": "critical", "value": "process exited with 101"}, {"importance": "critical", "value": "pool"}, {"type": "error", "importance": "important", "value": "a warning that is fine"},
        {"type": "error", "importance": "critical", "value": "Connection Pool Exhausted"}, {"type": "error", "importance": "critical", "value": "396 tests run: 395 passed"}, {"type": "error", "importance": "critical"},
    ]
    docs = [("a", json.dumps({"required_signals": signals})), ("b", json.dumps({"required_signals": signals[:1]})), ("c", "no JSON"), ("d", "{}"), ("e", None)]
    lines = [("a", "\x1b[31mconnection \x1b[1mpool\x1b[0m exhausted\x1b[0m at"), ("a", "in src/pool/acquire.rs:41"), ("b", "nothing of the kind"), ("b", None)]
    got = truth.markers(spark.createDataFrame(docs, "case_id string, document string"), spark.createDataFrame(lines, "case_id string, line string"))
    assert sorted((r["case_id"], r["place"], r["kind"], r["verdict"]) for r in got.collect()) == [
        ("a", 0, "error", "kept"), ("a", 1, "stack_location", "kept"), ("a", 2, "exit_code", "not text"), ("a", 3, "signal", "short"), ("a", 5, "error", "absent"), ("a", 6, "error", "absent"), ("a", 7, "error", "short"),
        ("b", 0, "error", "absent"),
    ]
    empty = truth.markers(spark.createDataFrame([], "case_id string, document string"), spark.createDataFrame(lines, "case_id string, line string"))
    assert empty.collect() == []
