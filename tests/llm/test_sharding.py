import zlib
from collections import Counter, defaultdict

import pytest

from incidentlens.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size long"


def test_rows_against_brute_force(spark, tmp_path):
    rows = [(i, "x" * (i * 37 % 400) + "é" * (i % 3), "s", 1) for i in range(500)]
    rows += [(7, None, "s", 1), (None, "n", "s", 1), (3, "long " * 5000, "s", 1), *rows[:4]]
    got = sharding.shard_rows(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a")).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    places, load, home = defaultdict(list), Counter(), {}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        assert home.setdefault(r["vslot"], r["shard"]) == r["shard"]
    for slots in places.values():
        assert sorted(slots) == list(range(len(slots)))
    light = [s for s in load if load[s] < 25_000]  # one document is larger than a fair share
    assert max(load[s] for s in light) - min(load[s] for s in light) <= 500
    texts = {}
    for i, t, _, _ in rows:
        texts.setdefault(t or "", set()).add(i)
    shard = defaultdict(set)
    for r in got:
        shard[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in shard.values())  # copies stay together
    for path in "ab":  # from the stored map, and from none
        again = sharding.shard_rows(spark.createDataFrame(rows[::-1], SCHEMA), str(tmp_path / path)).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.read_map(spark, str(tmp_path / "a"))[0] == 1  # the second run had nothing to change


def test_a_huge_group_of_copies_is_split(spark, tmp_path):
    rows = [(i, "copy", "s", 1) for i in range(900)] + [(i, f"own text {i}", "s", 1) for i in range(900, 2000)] + [(5000, "repeated row", "s", 1)] * 700
    got, load = sharding.shard_rows(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a")).collect(), Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert len(got) == 2700 and max(load.values()) - min(load.values()) < 40
    spread = Counter(r["shard"] for r in got if r["doc_id"] == 5000)
    assert max(spread.values()) < 350 and len({r["vslot"] for r in got if r["doc_id"] < 900}) > 6


def test_where_copies_go_does_not_depend_on_the_table(spark, tmp_path):
    own = [(i, "copy", "s", 1) for i in range(60)]
    rest = [(i, f"own text {i}", "s", 1) for i in range(100, 3000)]
    for name, rows in (("small", own), ("large", own + rest)):
        got = sharding.shard_rows(spark.createDataFrame(rows, SCHEMA), str(tmp_path / name)).where("doc_id < 100").collect()
        assert len({r["vslot"] for r in got}) == 1 and len(got) == 60


def test_a_grown_table_edits_the_stored_map(spark, tmp_path):
    path, rows = str(tmp_path / "map"), [(i, "x" * (i % 50), "s", 1) for i in range(3000)]
    before = {r["doc_id"]: (r["vslot"], r["shard"]) for r in sharding.shard_rows(spark.createDataFrame(rows, SCHEMA), path).collect()}
    first = sharding.read_map(spark, path)
    rows += [(i, f"more {i} " + "y" * (i % 90), "s", 1) for i in range(3000, 4500)]
    after = sharding.shard_rows(spark.createDataFrame(rows, SCHEMA), path).collect()
    second = sharding.read_map(spark, path)
    assert second[0] == first[0] + 1 and sharding.read_map(spark, path, first[0]) == first
    moved = {slot for slot, (a, b) in enumerate(zip(first[1], second[1], strict=True)) if a != b}
    assert 0 < len(moved) < sharding.SLOTS / 4
    assert all((r["shard"] != before[r["doc_id"]][1]) == (r["vslot"] in moved) for r in after if r["doc_id"] < 3000)
    with pytest.raises(ValueError, match="shards"):
        sharding.shard_rows(spark.createDataFrame(rows, SCHEMA), path, shards=4)


def test_map_is_edited_and_versioned(spark, tmp_path):
    weight = [(i * i) % 97 + 1 for i in range(512)]
    first = sharding.initial_map(8, 512)
    second = sharding.rebalanced(first, weight, 8)
    load = Counter()
    for s, o in enumerate(second):
        load[o] += weight[s]
    assert max(load.values()) - min(load.values()) <= 2
    assert sum(a != b for a, b in zip(first, second, strict=True)) < 100  # few slots move
    third = sharding.grown(second, weight, 8)
    assert all(b == a or b == 8 for a, b in zip(second, third, strict=True)) and 8 in third
    path = str(tmp_path / "map")
    for version, owner in enumerate((first, second, third)):
        sharding.write_map(spark, path, version, owner)
    assert sharding.read_map(spark, path) == (2, third) and sharding.read_map(spark, path, 0) == (0, first)
    assert not sharding.write_map(spark, path, 2, first) and sharding.read_map(spark, path) == (2, third)  # a version is stored once
    assert sharding.read_map(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        sharding.edited_map(spark, path, weight, 4)  # fewer shards than the map has


def test_empty(spark, tmp_path):
    assert sharding.shard_rows(spark.createDataFrame([], SCHEMA), str(tmp_path / "a")).collect() == []
