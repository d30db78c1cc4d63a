import random

import numpy as np

from incidentlens.llm import langid as L


def test_backpropagation_through_time_against_differences():
    net = L.Network(["a", "b", "c"], hidden=3, seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, label = rng.integers(60, 130, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)

    # The states are float32; widen them so that differences are exact enough.
    real = np.empty
    L.np.empty = lambda shape, dtype=float: real(shape, dtype=np.float64 if dtype == np.float32 else dtype)
    zeros = np.zeros
    L.np.zeros = lambda shape, dtype=float: zeros(shape, dtype=np.float64 if dtype == np.float32 else dtype)
    try:
        _, grads = net.gradients(x, label)
        for name, p in net.p.items():
            for _ in range(6):
                at = tuple(rng.integers(0, n) for n in p.shape)
                if name[0] == "W":
                    at = (int(x.ravel()[rng.integers(0, x.size)]), at[1])
                old, h = p[at], 1e-5
                p[at] = old + h
                up, _ = net.gradients(x, label)
                p[at] = old - h
                down, _ = net.gradients(x, label)
                p[at] = old
                assert abs((up - down) / (2 * h) - grads[name][at]) < 1e-6, name
    finally:
        L.np.empty, L.np.zeros = real, zeros


def test_both_forward_passes_agree():
    net = L.Network(["a", "b"], seed=5)
    x = np.random.default_rng(2).integers(0, 256, (20, 9)).astype(np.uint8)
    y, _ = net.logits(x)
    p = np.exp(y) / np.exp(y).sum(axis=2, keepdims=True)
    assert np.allclose(net.probabilities(x), p.transpose(0, 2, 1), atol=1e-5)


def corpus(n=260, seed=7):
    rng = random.Random(seed)
    stems = {"en": ["th", "er", "ing", "wh", "nd"], "fr": ["eau", "tion", "é", "que", "oi"], "de": ["sch", "ung", "ü", "keit", "ver"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(stems))
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang, "s"))
    return rows


def test_held_out_accuracy_and_cases(spark):
    rows = corpus()
    extra = [(900, None, "en", "s"), (901, "", None, "s"), (902, "12 3!", "en", "s"), (903, "th er ing " * 20_000, None, "s"), (None, "sch ung keit", "xx", "s"), rows[0]]
    got = L.identify(spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score string")).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[903]["lang_pred"] == "en"
    assert by[None]["held_out"] and all(0 <= r["score"] <= 1 for r in got)


def test_little_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    assert L.identify(spark.createDataFrame([], schema)).collect() == []
    assert L.identify(spark.createDataFrame([(1, "abc", None)], schema)).first()["lang_pred"] == "und"
    assert {r["lang_pred"] for r in L.identify(spark.createDataFrame([(1, "abc", "en"), (2, "def", "en"), (3, "x", None)], schema)).collect()} <= {"en", "und"}


def test_rows_without_text_do_not_thin_a_language(spark):
    real = [(i, f"real text {i}", "xx") for i in range(400)] + [(i, f"other {i}", "yy") for i in range(10)]
    hollow = [(1000 + i, "" if i % 2 else None, "xx") for i in range(30_000)] + [(9_001, "the same text", "xx")] * 30_000
    docs = spark.createDataFrame(real + hollow, "doc_id long, text string, lang string")
    got = [tuple(r) for r in L.sample(docs, "doc_id", "text", "lang", 20, 100).collect()]
    assert sum(r[1] == "xx" for r in got) == 20 and len({r[0] for r in got if r[1] == "xx" and r[0].startswith("real")}) > 10
