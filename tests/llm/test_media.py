import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from incidentlens.llm import media

SCHEMA = "doc_id long, text string, key string, own string"


def slow_cuts(data):
    """One byte at a time."""
    out, h, start = [], 0, 0
    for i, b in enumerate(data):
        h = (2 * h + int(media._GEAR[b])) & 0xFFFFFFFF
        n = i + 1 - start
        if i + 1 == len(data) or n >= media.MOST or n >= media.LEAST and h >> (32 - media.CUT_BITS) == 0:
            out.append(i + 1)
            start = i + 1
    return out


def test_cuts_are_those_of_a_rolling_hash():
    rng = random.Random(1)
    for n in (64, 200, 5000, 100_000):
        data = bytes(rng.randrange(97, 110) for _ in range(n))
        assert media.cuts(data) == slow_cuts(data)
    assert media.cuts(b"a" * 20_000) == slow_cuts(b"a" * 20_000)


def test_cuts_across_pieces(monkeypatch):
    data = bytes(random.Random(2).randrange(256) for _ in range(30_000))
    whole = media.cuts(data)
    monkeypatch.setattr(media.K, "PIECE", 1000)
    assert media.cuts(data) == whole


def test_round_trip_and_columns(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 9)))
    shared = " ".join(word() for _ in range(3000))
    texts = [None, "", "x" * 64, "short", shared, shared + " tail", "head " + shared, shared, " ".join(word() for _ in range(20_000))]
    rows = [(i, t, "k", "o") for i, t in enumerate(texts)] + [(5, texts[5], "k", "o"), (None, "short", "k", "o"), (None, "only null", "k", "o")]
    df = spark.createDataFrame(rows, SCHEMA)
    store = media.MediaStore(df)
    assert store.borrowed.count() > 2
    stored = sum(len(c["samples"]) for r in {bytes(r["key"]): r for r in store.store.collect()}.values() for c in r["own"])
    assert stored < sum(len(media.payload(t)[0]) for t in set(texts) - {None}) - 25_000
    restored = {(r["doc_id"], bytes(r["payload"])) for r in store.restore().collect()}
    assert restored == {(i, media.payload(t)[0]) for i, t, _, _ in rows}
    got = media.media_columns(df).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, _, _ in rows:
        data, n = media.payload(t)
        parts = media.chunks(data)
        form = media.head_of(parts) + b"".join(parts)
        want.append((i, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(form), hashlib.sha256(form).hexdigest(), media.feature(data, parts)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert media.media_columns(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_damaged_store_fails(spark):
    rng = random.Random(9)
    shared = " ".join(str(rng.randrange(10**6)) for _ in range(2000))
    store = media.MediaStore(spark.createDataFrame([(1, shared, "", ""), (2, "head " + shared, "", ""), (3, "z" * 500, "", "")], SCHEMA))
    good, borrowed = store.store, store.borrowed
    assert len(store.media().collect()) == 3 and borrowed.count()
    flipped = F.transform("own", lambda c: F.struct(c.at.alias("at"), F.concat(c.samples, F.lit(b"!")).alias("samples")))
    store.store = good.withColumn("own", flipped)
    with pytest.raises(Exception, match="differs from its digest"):
        store.media().collect()
    store.store = good.withColumn("own", F.slice("own", 1, 1))
    with pytest.raises(Exception, match="is missing"):
        store.media().collect()
    store.store, store.borrowed = good, borrowed.limit(0)
    with pytest.raises(Exception, match="is missing"):
        store.media().collect()
    store.store, store.borrowed = good.withColumn("n_bytes", F.col("n_bytes") - 1), borrowed
    with pytest.raises(Exception, match="payload .* differs"):
        store.media().collect()


def test_stored_beginnings_are_read_back_or_refused(spark):
    parts = [b"a" * 300, b"b" * 64]
    head = media.head_of(parts)
    assert media.listed_in(head) == [(300, media.digest(parts[0])), (64, media.digest(parts[1]))]
    for damaged in (b"", head[:-1], head + b"x", b"XXXX" + head[4:]):
        with pytest.raises(ValueError):
            media.listed_in(damaged)
    rows = [(1, "text one", "", ""), (2, None, "", "")]
    store = media.MediaStore(spark.createDataFrame(rows, SCHEMA))
    held = store.store.collect()
    assert {r["head"][:4] for r in held} == {media.MAGIC}
    got = {r["key"]: r for r in store.media().collect()}
    for r in held:  # the digests are of stored bytes
        whole = bytes(r["head"]) + b"".join(bytes(c["samples"]) for c in sorted(r["own"], key=lambda c: c["at"]))
        if len(r["own"]) == r["n_chunks"]:
            assert got[r["key"]]["media_sha256"] == hashlib.sha256(whole).hexdigest() and got[r["key"]]["media_bytes"] == len(whole)
