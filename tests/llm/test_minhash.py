"""Near duplicates against a brute-force comparison of all pairs of shingle sets."""

import random
import re

import pytest

from incidentlens.llm.minhash import bands_for, least_matches, near_duplicates

SCHEMA = "doc_id long, text string, source string, component_id long, kept string"


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_force(rows, percent):
    ids = sorted({i for i, _ in rows})
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def run(spark, rows, percent=85):
    df = spark.createDataFrame([(i, t, "s", 1, "x") for i, t in rows], SCHEMA)
    return sorted(tuple(r) for r in near_duplicates(df, percent=percent).collect())


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 6)))
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(word() for _ in range(rng.randint(1, 150))))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute_force(rows, 85)


def test_defined_cases(spark):
    long_text = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"),
        (7, long_text), (8, long_text + " tail"), (9, long_text), (9, long_text), (10, "É é"), (11, "é é"),
    ]
    assert run(spark, rows) == brute_force(rows, 85)


def test_null_ids_and_empty_table(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "x y")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (None, 1, None, False)], key=str)


def test_large_group_goes_through_blocks(spark, monkeypatch):
    from incidentlens.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(80):  # similarities on both sides of the threshold, all in the same buckets
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"x{i}-{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
    assert run(spark, rows) == brute_force(rows, 85)


def test_bounds():
    assert bands_for(85, 1e-6) == 24
    bounds = least_matches(120, 85, 1e-6)
    assert all(0 < m < n for n, m in bounds.items() if n > 20)
    assert list(bounds.values()) == sorted(bounds.values())


def test_further_stars_and_blocks_by_component(spark, monkeypatch, capsys):
    from incidentlens.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "STAR_ROWS", 16)
    rng = random.Random(11)
    base, rows = [f"t{i}" for i in range(100)], []
    for i in range(600):  # chains of copies of copies: many lie too far from any one centre
        words = list(base) if i < 5 else rows[rng.randrange(len(rows))][1].split()
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    dealt, real = [], minhash.materialize

    def spy(df, label, **options):
        out = real(df, label, **options)
        if label == "mixed":
            dealt.append(out[0].agg({"big_rows": "max", "other_rows": "max"}).first())
        return out

    monkeypatch.setattr(minhash, "materialize", spy)
    assert run(spark, rows) == brute_force(rows, 85)
    assert len(dealt) > 2  # further stars were tried before blocks


@pytest.mark.parametrize("percent", [80, 85])
def test_recall_against_all_pairs(spark, percent, capsys):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in docs.collect()}
    holders = {}
    for i, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    shared = {}
    for ids in holders.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    component = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, percent=percent).collect()}
    found = sum(component[a] == component[b] for a, b in links)
    with capsys.disabled():
        print(f"\nlinks at {percent}: {len(links)}, found {found}, recall {found / len(links):.4f}")
    assert len(links) > 50 and found == len(links)
