"""Evaluation: the skeleton and the text search on planted logs, and seeded wrong conclusions."""

import pytest

from incidentlens.agent import loop
from incidentlens.agent.provider import Scripted, Turn
from incidentlens.operators import cases
from incidentlens.plans.ingest import Options, ingest
from incidentlens.sources import generator


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cases")
    generator.write(generator.incident(3000), folder / "log.jsonl")
    return ingest(spark, folder / "log.jsonl", folder / "store", "cases", Options(salt="s")).store


def test_skeleton_cites_the_cause_but_not_the_precursor(store, tmp_path):
    case = cases.builtin()[0]
    store.clear_investigation()
    loop.skeleton(store)
    got = {c.name: c.passed for c in cases.score(store, case)}
    assert got[f"cites[{generator.CAUSE}]"] and not got[f"cites[{generator.PRECURSOR}]"] and got[f"does-not-lead-with[{generator.HERRING}]"] and got["citations-resolve"]
    path = cases.write_results({case.name: [cases.score(store, case)]}, tmp_path)
    assert path.exists() and cases.rates([cases.score(store, case)])["citations-resolve"] == "1/1"
    assert cases.judge(store, Scripted([Turn("supported")])) == [{"note_id": 1, "supported": True}]


def test_text_search_leads_with_the_herring(store):
    store.clear_investigation()
    assert cases.grep_note(store) == 1
    got = {c.name: c.passed for c in cases.score(store, cases.builtin()[0])}
    assert not got[f"does-not-lead-with[{generator.HERRING}]"]


def test_silence_is_not_scored(store):
    store.clear_investigation()
    got = {c.name: c.passed for c in cases.score(store, cases.builtin()[2])}
    assert got[f"does-not-lead-with[{generator.HERRING}]"] is None and got["citations-resolve"] is None


def test_seeded_conclusions_are_caught(store):
    got = cases.Seeded().run(store)
    assert got["fabricated-citation"] and got["volume-led"] and got["signal-ignored"]
    assert got["signal-accounted"]  # a sound one


def test_evaluation_commands(spark, store, tmp_path, capsys):
    from incidentlens import cli

    root = store.root
    store.clear_investigation()
    loop.skeleton(store)
    cli.main(["--root", root, "eval-seeded", "cases"], spark)
    cli.main(["--root", root, "eval-ranking", "cases"], spark)
    (tmp_path / "labelled.csv").write_text("LineId,Content,EventId\n" + "".join(f'{i},"disk {i} full",E\n' for i in range(20)))
    assert cli.main(["eval-templating", str(tmp_path / "labelled.csv")], spark) == 0
    out = capsys.readouterr().out
    assert "ok   fabricated-citation" in out and "cases: rank " in out and "grouping accuracy 1.0000" in out
    cli.main(["eval", "--case", cases.builtin()[0].name, "--out", str(tmp_path / "out")], spark)
    assert "citations-resolve 1/1" in capsys.readouterr().out


def test_report_says_what_metrics_call_for(store):
    from incidentlens.plans import report

    store.record("ingest", {"skipped_files": 3})
    data = report.collect(store)
    assert "3 files were passed over." in data["warnings"] and "3 files were passed over." in report.render(data, "markdown")


def test_labelled_corpus(spark):
    rows = [(i, f"user u{i} logged in" if i % 2 else f"disk {i} full", "E1" if i % 2 else "E2") for i in range(40)]
    df = spark.createDataFrame(rows, "LineId long, Content string, EventId string")
    assert cases.score_labelled(df).first()[0] == 1.0
