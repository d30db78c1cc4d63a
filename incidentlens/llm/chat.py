"""Minimum-cost repair of conversation roles, and rendering.

Legal conversations: at most one system turn at the start, then user and
assistant in turn, the last word the assistant's.  A turn may be kept, given
another role, or merged into the turn before it; empty turns may be inserted
anywhere.  Every action has a cost and dynamic programming over the automaton's
states finds the cheapest repair.

A turn acts on the automaton as a min-plus matrix that depends on its role alone,
and matrices compose.  So turns are sorted over the whole table (by range, a huge
conversation spans many partitions) and dealt into blocks of bounded length; a
conversation that spans blocks sends one matrix per block, the matrices tell each
block in which state the best path enters and leaves it, and blocks are then
repaired independently.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm.common import materialize

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 3, 1, 1, 2
BLOCK = 4096
#: A block ends before it holds more bytes of text than this, but for a single turn that does.
BLOCK_BYTES = 8 << 20
SHORT, CACHED_TURNS = 32, 1 << 17
INF = 1 << 40


def _fillings() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest run of inserted turns from state to state; the empty run from a state to itself."""
    out = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (a, b), path in list(out.items()):
            for c in NEXT[b]:
                if (a, c) not in out or len(path) + 1 < len(out[a, c]):
                    out[a, c] = (*path, c)
    return out


FILL = _fillings()


def _turn_options(role: int) -> dict[tuple[int, int], tuple[int, tuple[int, ...], str]]:
    """By (state before, state after): (cost, inserted before it, action) of the cheapest way to take a turn.

    role: 1 to 3, or 0 for a null or unknown one.  Ties: keep, merge, relabel, then the fewer insertions.
    """
    change = RELABEL if role else RELABEL_UNKNOWN
    out: dict[tuple[int, int], tuple] = {}
    for (a, mid), fill in FILL.items():
        ways = []
        for b in NEXT[mid]:
            ways.append((b, 0 if b == role else change, 0 if b == role else 2, "keep" if b == role else "relabel"))
        if mid != START and not fill:  # merging goes on with a turn that is there
            ways.append((mid, MERGE + (0 if mid == role else change), 1, "merge"))
        for b, cost, rank, action in ways:
            option = (cost + INSERT * len(fill), rank, len(fill), fill, action)
            if (a, b) not in out or option < out[a, b]:
                out[a, b] = option
    return {k: (v[0], v[3], v[4]) for k, v in out.items()}


OPTIONS = [_turn_options(r) for r in range(4)]
MATRIX = np.full((4, 4, 4), INF, dtype=np.int64)
for _r, _options in enumerate(OPTIONS):
    for (_a, _b), _o in _options.items():
        MATRIX[_r, _a, _b] = _o[0]
#: Cost of ending in a state: turns inserted until the assistant has the last word; nothing at all is legal too.
CLOSE = np.array([0 if s in (START, ASSISTANT) else INSERT * len(FILL[s, ASSISTANT]) for s in range(4)], dtype=np.int64)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product, cut off at INF."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), INF)


def matrix_of(codes: bytes) -> np.ndarray:
    total = np.where(np.eye(4, dtype=bool), 0, INF)
    for c in codes:
        total = compose(total, MATRIX[c])
    return total


def settle(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state at entry, state at exit) of each part of a conversation on its cheapest path from START to a close."""
    best = [CLOSE]
    for m in reversed(matrices):
        best.append(np.minimum((m + best[-1][None, :]).min(axis=1), INF))
    best.reverse()
    out, state = [], START
    for m, rest in zip(matrices, best[1:], strict=True):
        after = int(np.argmin(m[state] + rest))
        out.append((state, after))
        state = after
    return out


def repair_codes(codes: bytes, enter: int = START, leave: int | None = None) -> tuple[tuple[tuple[int, ...], str, int, int], ...]:
    """For each turn (inserted before, action, role after, state before); a leave of None closes the conversation."""
    return (_cached_repair if len(codes) <= SHORT else _repair)(codes, enter, leave)


def _repair(codes: bytes, enter: int, leave: int | None) -> tuple[tuple[tuple[int, ...], str, int, int], ...]:
    rest = np.full((len(codes) + 1, 4), INF, dtype=np.int64)
    rest[-1] = CLOSE if leave is None else np.where(np.arange(4) == leave, 0, INF)
    for i in range(len(codes) - 1, -1, -1):
        rest[i] = np.minimum((MATRIX[codes[i]] + rest[i + 1][None, :]).min(axis=1), INF)
    out, state = [], enter
    for i, c in enumerate(codes):
        after = int(np.argmin(MATRIX[c, state] + rest[i + 1]))
        _, fill, action = OPTIONS[c][state, after]
        out.append((fill, action, after, state))
        state = after
    return tuple(out)


#: Short conversations repeat their role sequences; the cache holds at most this many turns in all, some 30 MB.
_cached_repair = lru_cache(maxsize=CACHED_TURNS // SHORT)(_repair)


def safe(text: str | None) -> str:
    """Text that can't be read as a marker: a turn's own ``<|`` is rendered as ``< |``.  The input column keeps the original."""
    return (text or "").replace("<|", "< |")


def _opening(state: int, role: int) -> str:
    return ("" if state == START else "<|end|>\n") + f"<|{ROLES[role - 1]}|>\n"


def render(text: str | None, fill: tuple[int, ...], action: str, after: int, state: int, last: bool) -> str:
    """This turn's part of the rendered conversation; the parts of a conversation, in order, make the whole."""
    out = ""
    for role in fill:
        out += _opening(state, role)
        state = role
    out += ("\n" if action == "merge" else _opening(state, after)) + safe(text)
    if last:
        for role in FILL[after, ASSISTANT] if after != ASSISTANT else ():
            out += _opening(after, role)
            after = role
        out += "<|end|>\n"
    return out


def _blocks(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The turns in order, dealt into numbered blocks: block, pos, conv_id, turn, role, code, text, ends (last of its conversation)."""
    role = F.lower(F.trim(F.col(role_col).cast("string")))
    code = F.coalesce(*[F.when(role == name, F.lit(i + 1)) for i, name in enumerate(ROLES)], F.lit(0))
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
        code.alias("code"), F.col(text_col).cast("string").alias("text"),
    )
    # Equal rows are interchangeable, but they too are dealt out: salt spreads them over the range's partitions.
    keyed = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(997)))
    keyed, _ = materialize(keyed, "turns")
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "text", "salt"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "conv_id", "turn", "role", F.xxhash64("text"), "salt").sortWithinPartitions(*order)

    def number(batches):
        from pyspark import TaskContext

        block, n, rows, held = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in batches:
            at, blocks = np.arange(n, n + batch.num_rows), []
            n += batch.num_rows
            for size in pc.fill_null(pc.binary_length(batch.column(4)), 0).to_pylist():
                if rows and (rows == BLOCK or held + size > BLOCK_BYTES):
                    block, rows, held = block + 1, 0, 0
                rows, held = rows + 1, held + size
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(at), *batch.columns[:5]], names=["block", "pos", "conv_id", "turn", "role", "code", "text"])

    numbered = ordered.select("conv_id", "turn", "role", "code", "text").mapInArrow(
        number, "block long, pos long, conv_id long, turn long, role string, code int, text string"
    )
    return materialize(numbered, "blocks")[0]


def _pieces(conv: np.ndarray, null: np.ndarray) -> list[tuple[int, int]]:
    """Runs of one conversation in a sorted block."""
    change = np.flatnonzero((conv[1:] != conv[:-1]) | (null[1:] != null[:-1])) + 1
    edges = [0, *change.tolist(), len(conv)]
    return list(zip(edges[:-1], edges[1:], strict=True)) if len(conv) else []


def _ids(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    null = column.isna().to_numpy()
    return column.fillna(0).to_numpy(dtype=np.int64), null


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per input turn: conv_id, turn, role, repaired_role, action, inserted_before, inserted_after, rendered.

    Turns go by their number (nulls first), then by role and text.  ``inserted_*`` are the roles of the
    empty turns put in there; the ``rendered`` parts of a conversation, in order, are its whole text.
    A ``<|`` inside a text is rendered as ``< |``, so that no text can pass for a marker.
    Null or unknown roles may take any role at a low cost; a null text is empty.  Null conversation ids
    form one conversation.  Repeated rows are turns of their own.  An empty table gives no rows.
    """
    blocks = _blocks(turns, conv_col, turn_col, role_col, text_col)

    def border(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        ids, null = _ids(group["conv_id"])
        codes, rows, runs = group["code"].to_numpy(dtype=np.uint8), [], _pieces(ids, null)
        for a, b in dict.fromkeys((runs[0], runs[-1])):  # only these can go on in another block
            m = matrix_of(codes[a:b].tobytes())
            rows.append((int(group["block"].iat[0]), None if null[a] else int(ids[a]), [int(x) for x in m.ravel()]))
        return pd.DataFrame(rows, columns=["block", "conv_id", "matrix"])

    borders = blocks.select("block", "pos", "conv_id", "code").groupBy("block").applyInPandas(border, "block long, conv_id long, matrix array<long>")

    def join_up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        if len(group) < 2:
            return pd.DataFrame([], columns=["block", "conv_id", "enter", "leave"])
        path = settle([np.array(m, dtype=np.int64).reshape(4, 4) for m in group["matrix"]])
        leave = [b for _, b in path[:-1]] + [-1]
        return pd.DataFrame({"block": group["block"].to_numpy(), "conv_id": group["conv_id"].to_numpy(), "enter": [a for a, _ in path], "leave": leave})

    # One row per block and conversation: BLOCK times fewer than the turns.
    states = borders.groupBy("conv_id").applyInPandas(join_up, "block long, conv_id long, enter int, leave int")
    states = states.groupBy("block").agg(F.collect_list(F.struct("conv_id", "enter", "leave")).alias("states"))  # two at most
    joined = blocks.join(states, "block", "left")

    def fix(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        ids, null = _ids(group["conv_id"])
        known = {s["conv_id"]: (s["enter"], s["leave"]) for s in (group["states"].iat[0] if group["states"].iat[0] is not None else ())}
        codes, text = group["code"].to_numpy(dtype=np.uint8), group["text"].to_list()
        role, action, before, after, shown = [], [], [], [], []
        for a, b in _pieces(ids, null):
            enter, leave = known.get(None if null[a] else int(ids[a]), (START, -1))
            done = repair_codes(codes[a:b].tobytes(), enter, None if leave < 0 else leave)
            for i, (fill, act, now, state) in enumerate(done):
                last = leave < 0 and i == b - a - 1
                role.append(ROLES[now - 1])
                action.append("merge+relabel" if act == "merge" and codes[a + i] != now else act)
                before.append([ROLES[r - 1] for r in fill])
                after.append([ROLES[r - 1] for r in FILL[now, ASSISTANT]] if last else [])
                shown.append(render(text[a + i], fill, act, now, state, last))
        return pd.DataFrame({
            "conv_id": group["conv_id"].astype("Int64"), "turn": group["turn"].astype("Int64"), "role": group["role"], "repaired_role": role, "action": action,
            "inserted_before": before, "inserted_after": after, "rendered": shown,
        })

    return joined.groupBy("block").applyInPandas(
        fix, "conv_id long, turn long, role string, repaired_role string, action string, inserted_before array<string>, inserted_after array<string>, rendered string"
    )
