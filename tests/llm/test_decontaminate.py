import math
import random
from collections import Counter

import numpy as np
import pytest

from incidentlens.llm import decontaminate as D
from incidentlens.llm import kernels as K

DOCS, ITEMS = "doc_id long, text string, item_id string, similarity double", "item_id long, text string, doc_id string"


def shingles(words, k):
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_force(docs, items, threshold=0.8):
    sets = {i: shingles((t or "").lower().split(), 5) for i, t in items}
    length = {i: len((t or "").split()) for i, t in items}
    n = sum(bool(s) for s in sets.values())
    df = Counter(x for s in sets.values() for x in s)
    weight = lambda s: sum(math.log(1 + n / max(1, df[x])) for x in s)
    out = []
    for d, text in docs:
        words = (text or "").lower().split()
        for i, own in sets.items():
            size = min(length[i], len(words))
            if not own or not size:
                continue
            best = max(weight(w & own) / weight(w | own) for w in (shingles(words[p : p + size], 5) for p in range(len(words) - size + 1)))
            if best >= threshold:
                out.append((d, i, round(best, 9)))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 4, 5, 9, 20, 40, 60, 60])] + [(90, None), (91, " "), (92, "One Two")]
    items.append((93, items[5][1]))  # equal items
    docs = []
    for d in range(60):
        words = [word() for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.7:
            passage = rng.choice(items[:8])[1].upper().split()
            cut = rng.choice([0, 0, 0, 1, 3])
            words[rng.randint(0, len(words)) : 0] = passage[cut:]
        docs.append((d, " ".join(words)))
    docs += [(70, None), (71, ""), (72, "one two"), (73, "x one\ttwo y"), (74, ("filler " * 30_000) + items[6][1]), docs[0], docs[1]]
    got = D.contaminated(spark.createDataFrame([(d, t, "", 0.0) for d, t in docs], DOCS), spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)).collect()
    want = brute_force(docs, items)
    assert len(want) > 20
    assert sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got) == want


def test_passes_over_a_large_benchmark(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(20)]
    docs = [(i, "before " + t + " after", "", 0.0) for i, t in items] + [(99, "clean text of its own", "", 0.0)]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)
    monkeypatch.setattr(D, "PASS_BYTES", 1000)
    assert sorted((r[0], r[1]) for r in D.contaminated(*frames).collect()) == [(i, i) for i in range(20)]
    kept = D.clean_documents(*frames)
    assert kept.columns == frames[0].columns and [r[0] for r in kept.collect()] == [99]


@pytest.mark.parametrize("empty", [0, 1])
def test_empty(spark, empty):
    frames = [spark.createDataFrame([(1, "a b c d e f", "", 0.0)], DOCS), spark.createDataFrame([(1, "a b c d e f", "")], ITEMS)]
    frames[empty] = frames[empty].limit(0)
    assert D.contaminated(*frames).collect() == []


def test_passes_share_the_weights_of_the_whole_benchmark(spark, monkeypatch):
    rng = random.Random(8)
    template = [f"t{j}" for j in range(25)]
    items = [(i, " ".join(template + [f"w{i}x{j}" for j in range(10)])) for i in range(30)] + [(40, " ".join(template))] * 3
    docs = []
    for d in range(120):
        words = rng.choice(items[:30])[1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"changed{d}"
        docs.append((d, " ".join(words[rng.choice([0, 0, 2]) :])))
    frames = spark.createDataFrame([(d, t, "", 0.0) for d, t in docs], DOCS), spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)
    found = lambda: sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in D.contaminated(*frames).collect())
    once, kept = found(), sorted(r[0] for r in D.clean_documents(*frames).collect())
    monkeypatch.setattr(D, "PASS_BYTES", 1000)
    assert len(D._slices(frames[1], "item_id", "text")) > 5
    assert found() == once and 0 < len(kept) < len(docs)
    assert sorted(r[0] for r in D.clean_documents(*frames).collect()) == kept


def test_items_with_repeated_words(spark):
    items = [(1, "la la la la la la la la song of the day"), (2, "one two three " * 20), (3, "a b c d e f g h i j k l m n o p q r s t")]
    docs = [(1, "x y z la la la la la la la la song of the day z"), (2, "start " + "one two three " * 30), (3, "one two three four"), (4, items[2][1].upper() + " end"), (5, "la la la la la la")]
    frames = spark.createDataFrame([(d, t, "", 0.0) for d, t in docs], DOCS), spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)
    got = sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in D.contaminated(*frames).collect())
    assert got == brute_force(docs, items) and {g[:2] for g in got} == {(1, 1), (2, 2), (4, 3)}


def test_index_lists_every_item_within_the_radius():
    rng = np.random.default_rng(3)
    items = D.Items([(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(300)], 5, 0.8)
    prints = items.prints[rng.integers(0, 300, 400)].copy()
    bits = np.unpackbits(prints, axis=1)
    for row in bits:
        row[rng.choice(D.BITS, rng.integers(0, 60), replace=False)] ^= 1
    prints = np.packbits(bits, axis=1)
    distance = np.bitwise_count(prints[:, None, :] ^ items.prints[None, :, :]).sum(axis=2, dtype=np.int64)
    want = sorted(zip(*np.nonzero(distance <= D.RADIUS), strict=True))
    window, item, d = items.within_radius(12, prints)
    assert sorted(zip(window, item, strict=True)) == want and len(want) > 200 and (distance[window, item] == d).all()


def test_pieces_of_a_long_document(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) for n in (7, 12, 12, 30, 90)]
    words = []
    for _ in range(150):
        passage = rng.choice(texts).split()
        passage[rng.randrange(len(passage))] = "z"
        words += passage + ["x"] * rng.randint(0, 3)
    hashes, _ = K.word_hashes([" ".join(words).encode()])
    items = D.Items(list(enumerate(texts)), 5, 0.8)
    whole = items.matches(hashes)
    monkeypatch.setattr(D, "PIECE_WINDOWS", 64)
    assert items.matches(hashes) == whole and len(whole) >= 2


def test_memory_of_a_very_long_dense_document():
    import tracemalloc

    text = " ".join(f"i{j}" for j in range(200))
    hashes = np.tile(K.word_hashes([text.encode()])[0], 3000)  # 600,000 words of one item
    items = D.Items([(1, text)], 5, 0.8)
    tracemalloc.start()
    assert items.matches(hashes)[0][:2] == (1.0, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
