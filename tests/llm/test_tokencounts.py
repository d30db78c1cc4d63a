from collections import Counter

import pytest

from incidentlens.llm import tokencounts as T


def test_against_brute_force(spark):
    texts = [None, "", "a", "hello world", "hello  world\n", "é" * 300, "word " * 5000, "hello world", "<|endoftext|>"]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, n_docs string")
    path, pattern = T.default_vocabulary()
    lengths = [len(T.encoder(path, pattern).encode_ordinary(t or "")) for t in texts]
    sums = T.suffix_sums(T.histogram(df)).cache()
    got = {r["n_tokens"]: r for r in sums.collect()}
    assert set(got) == set(lengths) and max(lengths) > T.SPAN
    for n, r in got.items():
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_longer"] == sum(x > n for x in lengths) and r["tokens_longer"] == sum(x for x in lengths if x > n)
        assert r["docs_upto"] == sum(x <= n for x in lengths) and r["tokens_upto"] == sum(x for x in lengths if x <= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["share_upto"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for limit in (0, 3, 700, 10**6):
        assert T.at_limit(sums, limit).first()["truncated_total"] == sum(min(x, limit) for x in lengths)
    assert T.quantile(sums, 0.5).first()[0] == sorted(lengths)[4]


def test_empty(spark):
    empty = spark.createDataFrame([], "text string")
    assert T.suffix_sums(T.histogram(empty)).collect() == []


def test_documents_are_encoded_once_and_a_long_run_is_one_document(spark):
    texts = ["a b", None, "", "x" * 300_000, "é" * 50_000, " " * 100_000]
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, n_docs int")
    got = T.suffix_sums(T.histogram(docs))
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    rows = {r["n_tokens"]: r["n_docs"] for r in got.collect()}
    encode = T.encoder(*T.default_vocabulary()).encode_ordinary
    assert rows == dict(Counter(len(encode(t or "")) for t in texts))
