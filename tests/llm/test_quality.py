import random
import re

import pytest
from pyspark.sql import functions as F

from incidentlens.llm import quality

SCHEMA = "doc_id long, text string, n_words string, kept int, h string"


def plain(text, width=8):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, marked = {}, set()
    for i in range(len(words) - width + 1):
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            marked |= {i + k for i in at for k in range(width)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), n < 20 or 100 * len(marked) > 30 * n


def plain_verdict(text):
    """The rules in the order of their list, every one of them."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return not any([
        chars > 25 * len(words),
        2 * sum(c in "#*$%&|<>" for c in text) > chars,
        10 * sum(c.isalpha() for c in text) < 3 * chars,
        100 * sum(c in "�\0" for c in text) > len(text),
        2 * len(set(lines)) < len(lines) and len(lines) >= 10,
        10 * sum(x.rstrip(" ").endswith(("…", "...")) for x in lines) > 9 * len(lines) and len(lines) >= 10,
    ])


def texts():
    rng = random.Random(4)
    pool = ["alpha", "beta", "gamma", "délta", "*", "#1", "<b>", "x́", "𝒳y", "end.\n", "\n", "\t", "\x0b", "1234", "…\n", "wait...\n", "�"]
    out = [" ".join(rng.choice(pool) for _ in range(rng.randrange(200))) for _ in range(250)]
    phrase = " ".join(f"w{i}" for i in range(9))
    out += [f"{phrase} {phrase}", " ".join([phrase] * 3) + " " + " ".join(f"u{i}" for i in range(100)), "a " * 7, "a " * 8, "a " * 9, "a " * 5000, "same line here\n" * 40, "z" * 50_000, "| # " * 200]
    out += ["\n".join(f"line {i} goes on ..." for i in range(30)), "\n".join(f"line {i} stops here" for i in range(30)), "12 34 56 78 " * 10, " ".join(f"word{i}" for i in range(30_000))]
    return out + [None, "", " \n ", "\xa0" * 30]


def test_rows_against_brute_force(spark):
    rows = [(i, t, "s", 1, "h") for i, t in enumerate(texts())] + [(None, "x y z " * 9, "s", 1, "h"), (3, "same", None, None, None), (3, "same", None, None, None)]
    got = quality.judge(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = []
    for i, t, *_ in rows:
        base = plain(t)
        want.append((i, *base, not base[-1] and plain_verdict(t)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {True, False} == {r["kept"] for r in got if not r["base_failed"]}


def test_every_rule_rejects_something_and_none_prose(spark):
    rows = spark.createDataFrame([(i, t or "", "s", 1, "h") for i, t in enumerate(texts())], SCHEMA)
    hit = quality.measures(rows, "doc_id", "text").agg(*[F.sum(F.expr(r.rejects).cast("int")).alias(r.name) for r in quality.RULES]).first()
    assert all(hit[r.name] for r in quality.RULES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 200 and text not like '%|%|%|%'")
    clean = quality.judge(docs).where("not base_failed")
    assert clean.where("kept").count() >= 0.97 * clean.count()


def test_order_is_by_rejection_per_cost_of_what_is_left():
    rules = tuple(quality.Rule(n, "") for n in "abc")
    known = quality.Profile({"a": 1.0, "b": 1.0, "c": 4.0}, {frozenset("ab"): 50, frozenset("b"): 10, frozenset("c"): 30, frozenset(): 900})
    assert [r.name for r in quality.ordered(rules, known)] == ["b", "c", "a"]  # all that a rejects, b has rejected


@pytest.mark.parametrize("first", range(2))
def test_order_changes_no_verdict_and_stops_at_the_first_rejection(spark, first):
    fails = quality.Rule("fails", "cast(raise_error('asked') as boolean)")
    short = quality.Rule("short", "length(text) < 100000")
    docs = spark.createDataFrame([(1, "a b " * 20, "s", 1, "h")], SCHEMA)
    got = docs.select(quality.cascade([short, fails] if first == 0 else [short, short, fails], F.lit(False)).alias("kept")).collect()
    assert [r["kept"] for r in got] == [False]


def test_profile_counts_and_times(spark):
    docs = spark.createDataFrame([(i, "| # " * 100 if i % 4 == 0 else f"a line of words {i} " * 10, "s", 1, "h") for i in range(200)], SCHEMA)
    known = quality.profile(docs)
    assert sum(known.patterns.values()) == 200 and all(c > 0 for c in known.cost.values())
    assert sum(n for names, n in known.patterns.items() if "symbols" in names) == 50


def test_empty_table_and_no_python(spark):
    got = quality.judge(spark.createDataFrame([], SCHEMA))
    assert got.collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
