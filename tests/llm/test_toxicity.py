import math
import random
import zlib

import numpy as np
import pytest

from incidentlens.llm import toxicity as T


def slow_maximal(scores):
    """By the definition: the best segment (longest, then first), then the same to its left and right."""
    out = []

    def go(lo, hi):
        best = None
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                s = sum(scores[a:b])
                if s > 1e-9 and (best is None or s > best[0] + 1e-9):
                    best = (s, a, b)
        if best:
            go(lo, best[1])
            out.append((best[1], best[2] - 1, round(best[0], 6)))
            go(best[2], hi)

    go(0, len(scores))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_all_maximal_segments(seed):
    rng = random.Random(seed)
    scores = np.array([rng.choice([-1.37, -0.71, -0.113, 0.57, 1.291, 3.017]) + rng.random() * 1e-3 for _ in range(14)])
    hits, total = np.flatnonzero(scores > 0), np.cumsum(scores)
    got = [(int(hits[a]), int(hits[b]), round(s, 6)) for a, b, s in T.all_maximal(total[hits] - scores[hits], total[hits])]
    assert got == slow_maximal(scores.tolist())


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.8 else word() for _ in range(rng.randint(20, 300))]
        toxic = int(rng.random() < 0.15)
        for _ in range(rng.randint(2, 6) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["Zorgul,", "quux" + word(), "VILEXX"]))
        docs.append((i, " ".join(words), "s"))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_cases(spark):
    docs, labels = corpus()
    extra = [(9001, None, "s"), (9002, "", "s"), (9003, "12 34", "s"), (None, docs[0][1], "s"), docs[3], (9004, "word " * 60_000, "s")]
    frames = spark.createDataFrame(docs + extra, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = T.learn(*frames)
    got = T.score(frames[0], model).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert any(r["segments"] for r in got if r["predicted"]) and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["doc_id"]: r["score"] for r in got if r["doc_id"] in (9001, 9002, 9003)}
    assert len(set(blank.values())) == 1 and all(v < 0.5 for v in blank.values())
    kept = {r[0] for r in T.accepted(frames[0], model).collect()}
    assert kept - {None} == {r["doc_id"] for r in got if r["predicted"] == 0} - {None}


def test_empty_and_single_class(spark):
    docs, labels = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert 0 <= T.score(docs, T.learn(docs, labels)).first()["score"] <= 1
    assert T.score(docs.limit(0), T.learn(docs.limit(0), labels)).collect() == []
    assert T.fit([("a b c", 0), ("d e", 0)]).score(["a"])[0][0] < 0.5


@pytest.mark.parametrize("examples", [[("bad worse", 1)], [(f"bad {i} worse", 1) for i in range(10)], [("a b c", 0)], [("bad word here", 1), ("calm sea", 0)], [("", 1), ("12", 0)]])
def test_one_kind_of_text_and_halves_of_one_kind(examples):
    model = T.fit(examples)
    assert all(0 <= p <= 1 for p, _ in model.score([t for t, _ in examples] + ["", None, "other words"]))
    if {y for _, y in examples} == {1}:
        assert model.score([examples[0][0]])[0][0] >= 0.5


def test_any_split_of_two_texts_can_be_learned_from():
    rng = random.Random(2)
    for _ in range(60):
        pair = [(" ".join(rng.choice("abcdefgh") * 3 for _ in range(5)), y) for y in (0, 1)]
        assert all(0 <= p <= 1 for p, _ in T.fit(pair).score([pair[0][0], pair[1][0]]))


def test_log_odds_against_counting(monkeypatch):
    """The first level (shortest stems) by dictionaries over texts whose contexts are all different."""
    monkeypatch.setattr(T, "LEAST_LOG_ODDS", 0.05)
    texts, y = ["alpha beta gamma delta", "alpha zeta eta", "beta theta iota", "kappa alpha rho"], np.array([1, 0, 1, 0])
    counts = T.Counts(texts)
    got = counts.log_odds(y, np.array([True, True, True, False]))
    levels, first = T.tokens(texts)
    doc = np.repeat(np.arange(4), np.diff(first))
    base = (sum(y[d] for d in doc if d < 3) + 1) / (sum(d < 3 for d in doc) + 2)
    share = {}
    for h, d in zip(levels[0].tolist(), doc, strict=True):
        if d < 3:
            t, n = share.get(h, (0, 0))
            share[h] = (t + y[d], n + 1)
    want = {h: math.log(p / (1 - p)) - math.log(base / (1 - base)) for h, (t, n) in share.items() for p in [(t + T.PRIOR * base) / (n + T.PRIOR)]}
    want = {h: v for h, v in want.items() if v > T.LEAST_LOG_ODDS}
    assert dict(zip(got[0][0].tolist(), got[0][1].tolist(), strict=True)) == pytest.approx(want) and want


def test_what_is_learned_from_is_bounded_by_ids_rows_and_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").union(spark.range(4000).selectExpr("id % 40 + 1 as doc_id", "concat('other ', id % 3) as text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(T, "fit", lambda examples: seen.append(examples))
    T.learn(docs, labels, max_rows=5)
    T.learn(docs.repartition(7), labels.repartition(3), max_rows=5)
    assert len(seen[0]) == 5 and sorted(seen[0]) == sorted(seen[1])
    long = spark.createDataFrame([(i, "x" * (10_000 if i % 3 else 100)) for i in range(50)], "doc_id long, text string")
    T.learn(long, labels, max_bytes=25_000)
    assert seen[2] and sum(len(t) for t, _ in seen[2]) <= 25_000 and any(len(t) == 100 for t, _ in seen[2])


def test_repeated_labels_do_not_thin_the_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(600) for _ in range(100 if i % 2 else 1)] + [(7, 1)] * 40_000, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(T, "fit", lambda examples: seen.append(examples))
    T.learn(docs, labels, max_rows=100)
    assert len(seen[0]) == 100


def test_every_informative_feature_is_kept(spark):
    words = [f"t{''.join(chr(97 + int(c)) for c in f'{i:06d}')}" for i in range(210_000)]
    examples = [(" ".join(words[i : i + 500]), 1) for i in range(0, 210_000, 500)] + [(f"clean calm {'ab' * (i % 7)} {i}", 0) for i in range(2000)]
    model = T.fit(examples)
    assert sum(map(len, model.keys)) > 200_000  # ties in their log-odds included
    levels, _ = T.tokens([" ".join(words)])
    assert (model.token_scores(levels) > T.DRIFT).all()
