import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from incidentlens.llm import mixing
from tests.llm import plain_mixing

SCHEMA = "doc_id long, text string, source string, size long, tie string"


def corpus(seed, n=80):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choice([0, 1, 3, 50, 400])
        source = rng.choice(["a", "a", "a", "é", "z", None])
        rows.append((i, None if rng.random() < 0.05 else " ".join(["w x"] * words), source, 7, "t"))
    return rows + rows[:3]  # repeated rows


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("seed", range(6))
def test_targets_fill_up_under_the_cap(spark, seed):
    rng = random.Random(seed)
    names = rng.sample(["a", "b", "c", "é", "z", "A", "", "𝔘", "\uffff", None], rng.randint(1, 10))
    sizes = {s: rng.choice([0, 1, 10, 90, 100, 5000]) for s in names}
    sources = mixing.numbered(spark.createDataFrame(list(sizes.items()), "source string, size long"))
    rows = mixing.filled(sources.withColumn("weight", mixing.cyclic_weight(F.col("source"), F.col("number")).cast("double"))).collect()
    weights = plain_mixing.cyclic_weights(names)
    assert {r["source"]: r["weight"] for r in rows} == weights and sorted(r["number"] for r in rows) == list(range(len(names)))
    want = plain_mixing.targets(sizes, weights)
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(want) and sum(want.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permute(np.arange(n), n, 12345678901).tolist()) == list(range(n))


def test_draws_are_multinomial_over_what_is_lacking():
    goals, caps, totals = np.array([6000.0, 3000.0, 1000.0, 0.0]), np.array([10**6] * 4), mixing.shard_totals(10_000, 16)
    draws = [mixing.draw_counts(goals, caps, totals, np.random.default_rng(seed)) for seed in range(300)]
    assert all((d.sum(axis=0) == totals).all() and (d >= 0).all() and not d[3].any() for d in draws)
    first = np.array([d[:, 0] for d in draws])  # a plain multinomial over the weights
    assert np.allclose(first.mean(axis=0), 625 * goals / 10_000, atol=3) and np.allclose(first[:, 0].std(), (625 * 0.6 * 0.4) ** 0.5, rtol=0.2)
    off = np.array([d.sum(axis=1) - goals for d in draws])
    assert np.abs(off).max() < 5 * 625**0.5 and 3 < off[:, 0].std() < 25  # only the last shard's draw stays
    capped = mixing.draw_counts(np.array([30.0, 70.0]), np.array([10, 200]), mixing.shard_totals(100, 7), np.random.default_rng(1))
    assert capped.sum(axis=1).tolist() == [10, 90]
    assert mixing.draw_counts(np.array([5.0]), np.array([3]), np.array([5]), np.random.default_rng(1)).sum() == 3  # nothing else has room
    assert mixing.draw_counts(np.zeros(2), np.zeros(2, dtype=np.int64), np.array([0, 0]), np.random.default_rng(1)).sum() == 0
    assert mixing.shard_totals(10, 4).tolist() == [2, 3, 2, 3]


def test_the_draw_decides_what_is_taken(spark, monkeypatch):
    df = spark.createDataFrame(corpus(5), SCHEMA)
    rows = lambda: sorted((str(r["doc_id"]), r["taken"]) for r in mixing.plan(df, block=16).taken().collect())
    drawn, draw = rows(), mixing.draw_counts

    def even(goals, caps, totals, rng):
        share = np.minimum(np.round(goals).astype(np.int64), caps)
        return np.stack([share * (j + 1) // len(totals) - share * j // len(totals) for j in range(len(totals))], axis=1)

    monkeypatch.setattr(mixing, "draw_counts", even)
    assert rows() != drawn
    monkeypatch.setattr(mixing, "draw_counts", draw)
    assert rows() == drawn


def allowance(target, block, shards=mixing.SHARDS):
    """Words that a source may miss its target by: some blocks, and five deviations of one shard's draw."""
    return block * (4 + 5 * (target / block / shards) ** 0.5)


@pytest.mark.parametrize("seed", [1, 2])
def test_taken_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    planned = mixing.plan(df, block=16)
    got = planned.taken().collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], words(r[1])) for r in rows)
    times = Counter((r["source_no"], r["block"]) for r in planned.slots().collect())
    # Lay every source out again from its rows' starts and count each word of each slot.
    owner = defaultdict(dict)
    for r in planned.placed.where("size > 0").collect():
        for at in range(r["start"], r["start"] + r["size"]):
            assert at not in owner[r["source_no"]]
            owner[r["source_no"]][at] = (r["source_no"], r["start"])
    taken = Counter()
    for (no, block), n in times.items():
        for at in range(block * 16, block * 16 + 16):
            if at in owner[no]:
                taken[owner[no][at]] += n
    want = Counter((r["doc_id"], taken[r["source_no"], r["start"]] if r["size"] else 0) for r in planned.placed.collect())
    assert Counter((r["doc_id"], r["taken"]) for r in got) == want
    per = defaultdict(int)
    for r in got:
        per[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    for source, target in ((r["source"], r["target"]) for r in planned.facts.collect()):
        assert abs(per[source] - target) <= allowance(target, 16)
    again = mixing.plan(spark.createDataFrame(rows[::-1], SCHEMA), block=16).taken().collect()
    key = lambda x: sorted((r["doc_id"], r["taken"]) for r in x)
    assert key(again) == key(got)


def test_documents_are_repeated_or_left_out(spark):
    rows = [(i, "w " * 50, "big" if i < 300 else "small", i, "t") for i in range(400)]
    out = mixing.mixed_documents(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "source", "size", "tie"]
    n = Counter(r["source"] for r in out.collect())
    assert abs(n["big"] - 400 / 3) < 40 and abs(n["small"] - 800 / 3) < 40  # weights 1 and 2


def test_empty(spark):
    assert mixing.plan(spark.createDataFrame([], SCHEMA)).taken().collect() == []
    blank = spark.createDataFrame([(1, None, None, 0, ""), (2, " ", "s", 0, "")], SCHEMA)
    assert [(r["taken"], r["target"]) for r in mixing.plan(blank).taken().collect()] == [(0, 0.0)] * 2
    assert mixing.mixed_documents(blank).count() == 2


def test_small_sources_meet_their_targets(spark):
    sizes = {"ten": 10, "forty": 40, "more": 130, "odd": 1001, "big": 30_000}
    rows = [(i, "w " * n, s, n, "t") for i, (s, n) in enumerate(sizes.items())]
    planned = mixing.plan(spark.createDataFrame(rows, SCHEMA), weights=lambda source, number: F.when(source == "odd", 0.07).otherwise(1.0))
    goal = {r["source"]: r["target"] for r in planned.facts.collect()}
    taken = {r["source"]: r["taken"] for r in planned.taken().collect()}
    assert all(abs(taken[s] - goal[s]) <= allowance(goal[s], 64) and taken[s] <= 3 * sizes[s] for s in sizes)


def test_more_sources_than_a_person_names_and_clashing_columns(spark, monkeypatch):
    rows = [(i, "w x " * (1 + i % 40), f"s{i:04d}" if i % 3 else "hot") for i in range(1500)]
    names = ["_copies", "tie", "id", "row", "copies", "size", "source_no"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(7).alias(n) for n in names])
    monkeypatch.setattr(mixing, "GROUP", 128)  # eight bundles
    planned = mixing.plan(df)
    taken, goal = Counter(), {}
    for r in planned.taken().collect():
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert len(goal) == 1001 and all(abs(taken[s] - g) <= allowance(g, 64) for s, g in goal.items()) and abs(sum(taken.values()) - sum(goal.values())) < 0.1 * sum(goal.values())
    assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mixed_documents(df, max_repeats=100).count() > 0  # no bound on passes
