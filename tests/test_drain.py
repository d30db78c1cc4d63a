"""Parallel clustering against one serial pass, and going on from a stored state."""

import random

import pytest
from pyspark.sql import functions as F

from incidentlens.operators import drain, ranks


def frame(spark, messages, start=0, parts=4):
    return spark.createDataFrame(list(enumerate(messages, start)), "id long, message string").repartition(parts)


def serial(messages, **options):
    numbers, patterns = drain.cluster_serially(messages, **options)
    return {i: (n + 1, patterns[n]) for i, n in enumerate(numbers)}


def got(df):
    return {r["id"]: (r["template_id"], r["pattern"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(6))
def test_one_token_count_equals_the_serial_tree(spark, seed):
    """Leading tokens that are literal, wild, or literal only after a wildcard's child refused them."""
    rng = random.Random(seed)
    options = {"sim_th": rng.choice([0.3, 0.4, 0.6]), "max_children": rng.choice([3, 100])}
    lead = ["get", "put", "a1", "b2", "<*>", "del", "x9y"]
    rest = ["ok", "no", "7", "8", "user", "root", "eth0"]
    messages = [" ".join([rng.choice(lead), rng.choice(lead), *(rng.choice(rest) for _ in range(3))]) for _ in range(600)]
    assert got(drain.cluster(frame(spark, messages), **options)) == serial(messages, **options)


def test_log_like_lines_need_a_short_log(spark):
    rng = random.Random(7)
    shapes = ["user {} logged in from {}", "GET /api/{} took {} ms", "worker {} restarted after {}", "disk {} is full"]
    messages = [rng.choice(shapes).format(rng.randrange(1000), rng.choice(["east", "west", "10.0.0.1"])) for _ in range(4000)] + ["", "  ", "one two", "one\x1ctwo"]
    found = drain.cluster_on(frame(spark, messages))
    assert got(found.lines) == serial(messages)
    assert found.serial == [] and found.state.count() < 200


def test_cap_and_long_logs_fall_back_to_serial_groups(spark, monkeypatch):
    rng = random.Random(8)
    messages = [f"{rng.choice('abcdefgh')}{rng.choice('stuvw')} {rng.choice('klmnop')}{rng.choice('xyz')} z{rng.choice('qrs')}" for _ in range(500)]
    tree = drain.Drain(max_clusters=5)
    want = [tree.add(m.split()) for m in messages]
    found = drain.cluster_on(frame(spark, messages), max_clusters=5)
    assert found.serial == [3] and tree.evicted
    ids = got(found.lines)
    assert [ids[i][0] - 1 for i in range(500)] == want
    monkeypatch.setattr(drain, "LOG_LINES", 3)
    found = drain.cluster_on(frame(spark, messages))
    assert found.serial == [3] and got(found.lines) == serial(messages)
    monkeypatch.setattr(drain, "ROUNDS", 1)
    monkeypatch.setattr(drain, "LOG_LINES", 20_000)
    mixed = [" ".join(rng.choice("ab") for _ in range(4)) for _ in range(300)] + messages
    assert got(drain.cluster(frame(spark, mixed))) == serial(mixed)


def test_a_hot_shape_is_validated_in_every_task(spark):
    """All lines of one shape: the tree sees a few of them, every partition checks its own."""
    lines = spark.range(0, 20_000, 1, 8).selectExpr("id", "concat('job ', id % 977, ' took ', id % 31, ' s') as message")
    found = drain.cluster_on(lines)
    assert found.state.count() <= 4
    assert found.lines.agg(F.count("*").alias("n"), F.max("template_id").alias("t"), F.max("pattern").alias("p")).first().asDict() == {"n": 20_000, "t": 1, "p": "job <*> took <*> s"}
    rows = drain._rows(lines, "id", "message")
    logs = {5: [(r["line"], r["text"]) for r in found.state.collect()]}
    sizes = [r["n"] for r in drain._validated(rows, logs, {}).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2] and len(sizes) == 8


@pytest.mark.parametrize("cut", [1, 150, 399])
def test_state_goes_on_where_it_was(spark, cut):
    rng = random.Random(3)
    messages = [" ".join(rng.choice(["get", "put", "del", "x1"]) + rng.choice(["", "a", "7"]) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    first = drain.cluster_on(frame(spark, messages[:cut]))
    state = drain.usable(ranks.written(drain.stamped(first.state)))
    second = drain.cluster_on(frame(spark, messages[cut:], cut), state)
    whole = drain.cluster_on(frame(spark, messages))
    want = serial(messages)
    assert got(second.lines) == {i: want[i] for i in range(cut, 400)}
    assert sorted(map(tuple, second.templates.collect())) == sorted(map(tuple, whole.templates.collect()))
    assert sorted(map(tuple, second.state.collect())) == sorted(map(tuple, whole.state.collect()))
    with pytest.raises(ValueError):
        drain.cluster_on(frame(spark, messages[:cut]), state)


def test_damaged_states_are_refused(spark, tmp_path):
    state = drain.cluster_on(frame(spark, ["a 1", "a 2", "b c d"])).state
    good = drain.stamped(state)
    assert drain.usable(good).count() == 3
    assert drain.usable(good, sim_th=0.5) is None and drain.usable(None) is None
    assert drain.usable(good.withColumn("version", F.lit(99))) is None
    assert drain.usable(good.drop("line")) is None
    assert drain.usable(good.withColumn("n_tokens", F.col("n_tokens") + 1)) is None
    assert drain.usable(good.withColumn("text", F.lit(None).cast("string"))) is None
    good.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for part in (tmp_path / "t").glob("part-*"):
        part.write_bytes(b"no parquet")
    assert drain.usable(stored) is None


def test_empty_table_and_ranks(spark):
    assert drain.cluster(frame(spark, ["x"]).limit(0)).collect() == []
    rows = spark.range(0, 1000, 1, 7).selectExpr("id % 10 as k", "id")
    placed = ranks.numbered(rows, ["k", "id"], "place").orderBy("place").collect()
    assert [(r["k"], r["id"]) for r in placed] == sorted((i % 10, i) for i in range(1000)) and [r["place"] for r in placed] == list(range(1, 1001))


def _plain_numbers(messages, sim_th, cap):
    """Drain without leaves' rows: every template of a leaf is compared token by token."""
    tree, held, numbers = drain.Drain(sim_th=sim_th, max_clusters=cap), {}, []
    for message in messages:
        tokens, found, top = message.split(), None, (-1.0, -1)
        leaf = tree._leaf(tokens, False)
        for number in leaf.numbers if leaf is not None else ():
            if number not in tree.clusters:
                continue
            template = tree.clusters[number]
            same = sum(a == b for a, b in zip(template, tokens, strict=True) if a != drain.WILD)
            key = (same / len(tokens) if tokens else 1.0, template.count(drain.WILD))
            if key > top:
                found, top = number, key
        numbers.append(tree.take(tokens, found if top[0] >= sim_th else None))
        held[numbers[-1]] = " ".join(tree.clusters[numbers[-1]])
    return numbers, held


def test_rows_of_a_leaf_find_what_comparing_tokens_finds(monkeypatch):
    monkeypatch.setattr(drain, "VOCABULARY", 20)  # words are forgotten all the time
    rng = random.Random(3)
    for cap in (1, 4, 10_000):
        words = [*"abcdefgh", "x1", "y22", "<*>"]
        messages = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 4, 7]))) for _ in range(600)]
        for sim_th in (0.3, 0.5, 1.0):
            assert drain.cluster_serially(messages, sim_th=sim_th, max_clusters=cap) == _plain_numbers(messages, sim_th, cap)


def test_a_leaf_of_many_templates_is_not_compared_token_by_token():
    """6,000 templates in one leaf: 18 million comparisons of templates took a minute and more, and every task that replayed the log took them again."""
    import time

    lines = ["same start " + " ".join(f"w{i}-{j}" for j in range(20)) for i in range(6000)]
    began = time.process_time()
    numbers, _ = drain.cluster_serially(lines)
    assert numbers == list(range(6000)) and time.process_time() - began < 15
    tree = drain.Drain()
    tree._best = None  # a log is taken in without a search
    assert [tree.take(line.split(), None) for line in lines] == numbers and tree.take(lines[7].split(), 7) == 7


def test_an_indexed_leaf_finds_what_comparing_tokens_finds(monkeypatch):
    monkeypatch.setattr(drain, "INDEX_ROWS", 3)
    monkeypatch.setattr(drain, "VOCABULARY", 20)  # ids change while there is an index
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)] + list("abcdefgh") + ["<*>"]
    for cap in (5, 60, 10_000):
        messages = [" ".join(["go", *(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 7])))]) for _ in range(1500)]
        for sim_th in (0.3, 0.5, 1.0):
            assert drain.cluster_serially(messages, sim_th=sim_th, max_clusters=cap) == _plain_numbers(messages, sim_th, cap)


def test_a_line_is_compared_with_few_templates_of_its_leaf(monkeypatch):
    """3,000 templates of 20 tokens: every line was compared with all of them, which is most of the time of a token count at its cap."""
    import types

    import numpy as np

    met = []

    def counted(a, **options):
        met.append(a.shape[0])
        return np.count_nonzero(a, **options)

    monkeypatch.setattr(drain, "np", types.SimpleNamespace(**{n: getattr(np, n) for n in dir(np) if not n.startswith("__")} | {"count_nonzero": counted}))
    rng = random.Random(9)
    lines = ["same start " + " ".join(rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(18)) for _ in range(3000)]
    numbers, _ = drain.cluster_serially(lines)
    assert numbers == list(range(3000)) and sum(met) < 3000 * 3000 / 2 / 3


def test_serial_groups_write_each_template_once(spark):
    lines = ["get a 1", "get a 2", "put b", "put c", "", "del x y", "get q 7", "set r s"]
    rows = drain._rows(frame(spark, lines), "id", "message")
    out = drain._serially(rows, {"max_clusters": 2}).collect()
    assert sorted(r["line"] for r in out if r["pattern"] is None) == list(range(8))
    heads = {(r["n_tokens"], r["line"], r["pattern"]) for r in out if r["pattern"] is not None}
    tree, want = drain.Drain(max_clusters=2), {}
    for i, line in enumerate(lines):
        if len(line.split()) == 3:
            number = tree.add(line.split())
            want[number] = (3, want.get(number, (3, i, ""))[1], " ".join(tree.clusters[number]))
    assert {h for h in heads if h[0] == 3} == set(want.values()) and len([r for r in out if r["pattern"] is not None]) == len(heads)
