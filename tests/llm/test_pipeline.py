"""The corpus pipeline against a stage-by-stage account of a planted corpus."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import plain_mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = tmp_path_factory.mktemp("corpus")
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7))) for _ in range(2000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, labels, kind = [], [], {}
    items = [(i, " ".join(fresh(30))) for i in range(5)]

    def put(words, what, source=None):
        doc_id = len(docs)
        text = " ".join(words)
        docs.append((doc_id, text, "en", source or rng.choice(["s1", "s1", "s2"]), len(text)))
        kind[doc_id] = what
        return doc_id

    for i in range(400):
        toxic = i % 8 == 0
        words = fresh(rng.randint(40, 120))
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["grakko", "zimbult"]))
        labels.append((put(words, "toxic" if toxic else "clean"), 1, int(toxic)))
    originals = [d for d in list(docs) if kind[d[0]] == "clean"][:40]
    for d in originals:
        words = d[1].split()
        words[rng.randrange(len(words))] = "changed"
        put(words if len(words) > 90 else d[1].split(), "copy")
    for i in range(10):
        words = fresh(80)
        words[20:20] = items[i % 5][1].split()
        put(words, "leak")
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))
    return folder, docs, kind


def test_stages(spark, corpus):
    folder, rows, kind = corpus
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(folder))
        path = str(folder / f"out-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = docs
    ids = lambda name: {r[0] for r in seen[name].select("doc_id").collect()}
    of = lambda *what: {i for i, k in kind.items() if k in what}
    assert ids("toxicity") == of("clean", "copy", "leak")
    assert ids("near_duplicates") == of("clean", "leak")
    assert ids("decontamination") == of("clean")
    words = Counter()
    for r in seen["decontamination"].collect():
        words[r["source"]] += len(r["text"].split())
    goal = plain_mixing.targets(dict(words), plain_mixing.cyclic_weights(list(words)))
    mixed = Counter()
    for r in seen["source_mix"].collect():
        mixed[r["source"]] += len(r["text"].split())
    assert all(abs(mixed[s] - goal[s]) < 0.15 * goal[s] for s in goal)
    last = seen["sharding"].collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in last) == Counter((r["doc_id"], r["text"], r["source"]) for r in seen["source_mix"].collect())


def test_run_is_the_stages(spark, corpus):
    folder, _, _ = corpus
    got = corpus_pipeline.run(spark, str(folder)).select("doc_id", "shard").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in spark.read.parquet(str(folder / "out-source_mix")).select("doc_id").collect())
    assert {r["shard"] for r in got} == set(range(8))


def test_empty(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_nameless_rows_are_one_document(spark):
    text = lambda tag, n=40: " ".join(f"{tag}{i}" for i in range(n))
    row = lambda i, t: (i, t, "en", "s", 7)
    repeated = [row(1, text("a"))] * 30 + [row(2, text("b")), row(2, text("c")), row(3, None), row(3, None)]
    nameless = [row(None, text("d"))] * 5 + [row(None, text("a")), row(None, text("e")), row(None, None), row(None, " ")]
    others = [row(4, text("f")), row(5, text("f")), row(5, text("f")), row(6, text("g"))]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(repeated + nameless + others, DOCS), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = [tuple(r) for r in out.collect()]
    assert Counter(r[0] for r in got) == {1: 1, 2: 1, 3: 1, 4: 1, 6: 1, None: 4}
    assert row(1, text("a")) in got and next(r for r in got if r[0] == 2)[1] in (text("b"), text("c"))
    assert Counter(r[1] for r in got if r[0] is None) == {text("d"): 1, text("e"): 1, None: 1, " ": 1}


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    words = lambda tag, n=60: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(i, words(f"d{i}x"), "en", None if i % 5 else "s", 7, "extra", i) for i in range(40)]
    rows += [(50, None, None, None, None, None, None), (51, "", "en", "s", 0, "e", 1), (None, words("n"), "en", "s", 1, "e", 2), (52, "long " + words("L", 60_000), "en", "t", 1, "e", 3), rows[0], rows[0]]
    spark.createDataFrame(rows, DOCS + ", shard string, slot int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (3, words("d7x", 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert 7 not in ids and {50, 51} <= ids and ids <= {*range(40), 50, 51, 52, None}
    texts = {r[0]: r[1] for r in rows}
    assert all(r["text"] == texts[r["doc_id"]] for r in got) and {r["shard"] for r in got} <= set(range(8))


def test_rows_that_share_id_and_text_keep_their_columns(spark):
    rows = [(None, " ", "en", "a", 1), (None, " ", "fr", "b", 1), (None, " ", None, "b", 1), (None, " ", "b", None, 1), (7, "t", "en", "a", 1), (7, "t", "en", "c", 1), (7, "t", "en", "c", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = corpus_pipeline.deal_shards(spark, docs, "")
    key = lambda r: str((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]))
    assert sorted(map(key, out.collect())) == sorted(map(key, docs.collect()))
    assert "_whole" not in out.columns
    mixed = corpus_pipeline.deal_shards(spark, corpus_pipeline.mix_sources(spark, docs, ""), "").collect()
    assert {(r["lang"], r["source"]) for r in mixed if r["doc_id"] is None} == {("en", "a"), ("fr", "b"), (None, "b"), ("b", None)}
