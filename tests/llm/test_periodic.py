import hashlib
import random
import zlib

import numpy as np
import pytest

from incidentlens.llm import periodic

SCHEMA = "doc_id long, text string, start string, n_runs long"


def slow_runs(ids):
    """All maximal repetitions with 12 words and two periods or more, one distance after the other."""
    n, best = len(ids), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            if i + q - start >= max(12, 2 * q):
                best.setdefault((start, i + q), q)
    return sorted((a, b - a, q) for (a, b), q in best.items())


def test_blocks_cover_every_distance():
    covered = {}
    block = 2
    while block <= 1 << 12:
        low, high = periodic.distances(block)
        for d in range(low, high + 1):
            if max(d, 12 - d) >= 2 * block - 1:
                covered[d] = block
        block *= 2
    assert set(range(1, 10_000)) <= set(covered)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_against_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(400):
        n = rng.randrange(0, 90)
        ids = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(4)):  # planted repeats, also inside one another
            if n > 4:
                a, p = rng.randrange(n), rng.randrange(1, 20)
                end = min(n, a + p * rng.randrange(2, 6) + rng.randrange(p))
                for i in range(a + p, end):
                    ids[i] = ids[i - p]
        assert periodic.runs(np.array(ids, dtype=np.int64)) == slow_runs(ids), ids


def test_long_words_of_fibonacci_and_morse():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert periodic.runs(np.array(b)) == slow_runs(b)
    morse = [bin(i).count("1") % 2 for i in range(1024)]
    assert periodic.runs(np.array(morse)) == slow_runs(morse)
    same = [0] * 30_000
    assert periodic.runs(np.array(same)) == [(0, 30_000, 1)]


def test_wide_vocabulary_is_spelt_in_digits():
    rng = random.Random(5)
    ids = [rng.randrange(3000) for _ in range(20_000)]
    ids[15_000:18_000] = ids[12_000:15_000]
    got = periodic.runs(np.array(ids))
    assert (12_000, 6000, 3000) in got
    order = list(range(700)) * 3
    assert periodic.runs(np.array(order)) == [(0, 2100, 700)]


def test_chance_meetings_of_hashes_are_mended(monkeypatch):
    rng = random.Random(6)
    ids = np.array([rng.randrange(2) for _ in range(120)])
    monkeypatch.setattr(periodic, "_BASE", np.uint64(0))  # every stretch seems equal
    assert periodic.runs(ids) == slow_runs(ids.tolist())


def plain_row(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    top = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    longest = (*top[0], 1000 * top[0][1] // top[0][2]) if top else (None,) * 4
    return (doc_id, len(found), *longest, *(hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{m},{q}\n" for s, m, q in found), " ".join(kept))))


def test_rows_against_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "é", "wörd", "x y"]) for _ in range(rng.randrange(120))) for _ in range(120)]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(7, None, "s", 1), (8, "", None, None), (None, "na " * 40, "s", 1), (9, " \n\t ", "s", 1), (3, texts[3], "s", 1), (3, texts[3], "s", 1)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain_row(i, t)) for i, t, _, _ in rows)
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(str(plain_row(r["doc_id"], r["text"])) for r in docs.collect() if len(r["text"] or "") < 15_000)
    got = {str(tuple(r)) for r in periodic.periodic_runs(docs).collect()}
    assert len(got) == docs.count() and set(want) <= got
