import itertools
import random

import numpy as np
import pytest

from incidentlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, block long"


def legal(roles):
    roles = roles[1:] if roles[:1] == [chat.SYSTEM] else roles
    return len(roles) % 2 == 0 and all(r == (chat.USER, chat.ASSISTANT)[i % 2] for i, r in enumerate(roles))


def cheapest(codes, longest=9):
    """Least cost over all legal outputs, by alignment of the turns with each output."""
    best = chat.INF
    for n in range(longest + 1):
        for lead in ([], [chat.SYSTEM]):
            body = n - len(lead)
            if body < 0 or body % 2:
                continue
            out = [*lead, *[(chat.USER, chat.ASSISTANT)[i % 2] for i in range(body)]]
            if not legal(out) or len(lead) and not body:
                continue
            # cost[i][j]: first i turns laid into the first j outputs, the j-th being open.
            cost = np.full((len(codes) + 1, n + 1), chat.INF)
            cost[0, 0] = 0
            for i in range(len(codes) + 1):
                for j in range(n + 1):
                    if j:
                        cost[i, j] = min(cost[i, j], cost[i, j - 1] + chat.INSERT)
                        if i:
                            c = codes[i - 1]
                            change = 0 if c == out[j - 1] else chat.RELABEL if c else chat.RELABEL_UNKNOWN
                            cost[i, j] = min(cost[i, j], cost[i - 1, j - 1] + change, cost[i - 1, j] + chat.MERGE + change)
            best = min(best, int(cost[len(codes), n]))
    return best


def price(codes, done):
    total, out = 0, []
    for c, (fill, action, after, _) in zip(codes, done, strict=True):
        out += fill
        total += chat.INSERT * len(fill) + (0 if c == after else chat.RELABEL if c else chat.RELABEL_UNKNOWN)
        if action == "merge":
            assert out and out[-1] == after
            total += chat.MERGE
        else:
            out.append(after)
    end = chat.FILL[done[-1][2], chat.ASSISTANT]
    assert legal([*out, *end])
    return total + chat.INSERT * len(end)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_repairs_are_cheapest(n):
    for codes in itertools.product(range(4), repeat=n):
        codes = bytes(codes)
        assert price(codes, chat.repair_codes(codes)) == cheapest(codes), list(codes)


def rows_of(seed, n=40, length=12):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, length)):
            out.append((conv, turn, rng.choice(["system", "user", "assistant", "User ", "tool", None]), rng.choice(["hi", None, "<|user|>"]), 5))
    return out


def rendered(df):
    text = {}
    for r in sorted(df.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        text.setdefault(r["conv_id"], []).append(r)
    return text


@pytest.mark.parametrize("block", [3, 4096])
def test_blocks_do_not_matter(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = rows_of(3)
    got = rendered(chat.repair(spark.createDataFrame(rows, SCHEMA)))
    code = {"system": 1, "user": 2, "assistant": 3}
    for conv, parts in got.items():
        own = [r for r in rows if r[0] == conv]
        assert len(parts) == len(own)
        codes = bytes(code.get((r[2] or "").strip().lower(), 0) for r in own)
        out, total = [], 0
        for c, p in zip(codes, parts, strict=True):
            new = code[p["repaired_role"]]
            total += chat.INSERT * (len(p["inserted_before"]) + len(p["inserted_after"])) + (chat.MERGE if p["action"].startswith("merge") else 0)
            total += 0 if c == new else chat.RELABEL if c else chat.RELABEL_UNKNOWN
            out += [code[x] for x in p["inserted_before"]] + ([] if p["action"].startswith("merge") else [new]) + [code[x] for x in p["inserted_after"]]
        assert legal(out) and total == price(codes, chat.repair_codes(codes))
        whole = "".join(p["rendered"] for p in parts)
        shown = [line for line in whole.split("\n") if line.startswith("<|") and line != "<|end|>"]
        assert shown == [f"<|{chat.ROLES[r - 1]}|>" for r in out] and whole.count("<|end|>") == len(out)


def test_defined_cases(spark):
    rows = [(None, None, None, None, 1), (None, 1, "user", "x", 1), (1, 0, "user", "q", 1), (1, 0, "user", "q", 1)]
    got = chat.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and sorted(r["action"] for r in got if r["conv_id"] == 1) == ["keep", "merge"]
    assert chat.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_are_cut_by_bytes(spark, monkeypatch):
    rows = [(1, t, "user" if t % 2 else "assistant", "x" * 900, 5) for t in range(40)] + [(2, 0, "user", "y" * 9000, 5), (3, 0, None, None, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, chat.repair(df).collect()))
    monkeypatch.setattr(chat, "BLOCK_BYTES", 4000)
    assert sorted(map(str, chat.repair(df).collect())) == want
    sizes = chat._blocks(df, "conv_id", "turn", "role", "text").groupBy("block").agg({"text": "count", "pos": "count"}).count()
    assert sizes >= 11
