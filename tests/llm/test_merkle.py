import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from incidentlens.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, leaf string, n int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    out = []
    for v in row:
        text = "" if v is None else str(v)
        out.append("-" if v is None else f"{len(text.encode())}:{text}")
    return h(*out)


def tree(level):
    """(last node, for each leaf its (siblings before, siblings after) by level)."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for leaf, pos in enumerate(at):
            run = level[pos // 3 * 3 : pos // 3 * 3 + 3]
            paths[leaf].append((run[: pos % 3], run[pos % 3 + 1 :]))
        at = [p // 3 for p in at]
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def plain(rows):
    """The contract's rows, by lists; ``rows`` are (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for _, _, leaf, _ in sorted(groups[s], key=lambda r: r[:3])]) for s in names}
    root, upper = tree([trees[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for pos, (_, _, leaf, row) in enumerate(sorted(groups[s], key=lambda r: r[:3])):
            path, node = trees[s][1][pos] + upper[k], leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                node = leaf_of((*row[:4], row[4].replace("\n", "")))
            for before, after in path:
                node = h(*before, node, *after)
            out.append((row[0], leaf, trees[s][0], root, h(*[x for b, a in path for x in b + a]), node, node == root))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, "x", "y", 1) for i, s, lang, n, t in rows], SCHEMA)


def test_rows_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for source, n in [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("é", 27), ("z", 28), ("hot", 900), (None, 82), ("", 10)]:
        for _ in range(n):
            text = rng.choice([None, "", "no line feed", "two\nlines\n", "ünï\n\ncode", "x" * rng.randrange(3000)])
            rows.append((rng.randrange(2000), source, rng.choice(["en", None]), rng.choice([None, 3, -1]), text))
    rows += [(None, "a", None, None, None), (None, None, "en", 1, "t\nt")] + rows[:5]  # no ids, repeated rows
    want = Counter(plain(rows))
    for given in (rows, rows[::-1]):
        got = [tuple(r) for r in merkle.manifest(frame(spark, given)).collect()]
        assert Counter(got) == want
    assert {True, False} == {r[-1] for r in want}


@pytest.mark.parametrize("rows", [[(5, "s", "en", 1, "a\nb")], [(1, "s", None, None, "x"), (2, "t", None, None, "y")], [(7, None, None, None, None)] * 4])
def test_few_rows(spark, rows):
    assert Counter(tuple(r) for r in merkle.manifest(frame(spark, rows)).collect()) == Counter(plain(rows))


def test_empty_table(spark):
    got = merkle.manifest(frame(spark, []))
    assert got.collect() == [] and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_a_changed_row_changes_the_root_and_nothing_else_holds_it(spark):
    rows = [(i, f"s{i % 5}", "en", i, f"text {i}\n") for i in range(200)]
    root = merkle.manifest(frame(spark, rows)).first()["root"]
    rows[77] = (77, "s2", "en", 77, "text 77")
    again = merkle.manifest(frame(spark, rows)).collect()
    assert {r["root"] for r in again} != {root}
    assert all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 2 == 1 or r["doc_id"] == 77) for r in again)


def test_equal_rows_are_numbered_in_many_tasks(spark):
    rows = spark.range(20_000).selectExpr("'=a' as grp", "7L as doc_id", "'x' as leaf")
    got = merkle.numbered(rows, ["doc_id", "leaf"])
    assert sorted(r["pos"] for r in got.collect()) == list(range(20_000))
    assert got.select("n").distinct().collect()[0]["n"] == 20_000
