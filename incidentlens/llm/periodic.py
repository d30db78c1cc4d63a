"""Runs: stretches of a text's words that repeat with a period, by matching aligned blocks.

Blocks of 2, 4, 8, ... words that start at multiples of their length are the keys of an automaton over
sequences of integers, and the whole document is searched for them.  A block of b words that occurs again at
a distance which fits its scale (``distances``) is a seed: every run of that period holds such a
block before its last period.  Seeds are extended both ways, by comparing polynomial prefix hashes first and
words then.  A block can only occur again where its halves do, so most texts need two or three short searches.

A text is one row of its batch and is handled whole; memory and time grow with n log n of its n words.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm import kernels as K

LEAST, DIGIT = 12, 256
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_COLUMNS = [
    ("doc_id", pa.int64(), "long"), ("n_runs", pa.int64(), "long"), ("start", pa.int64(), "long"), ("length", pa.int64(), "long"), ("period", pa.int64(), "long"),
    ("exponent_milli", pa.int64(), "long"), ("runs_sha256", pa.string(), "string"), ("collapsed_sha256", pa.string(), "string"),
]


def distances(block: int) -> tuple[int, int]:
    """The first and last distance whose runs are sure to hold an aligned block of ``block`` words a period before their end.

    A run with period d has max(12, 2d) words or more; all but its last d hold an aligned block whenever they are 2 * block - 1.
    Distances of five words or less need no block over four, and six is the one that only a block of two is sure to meet.
    """
    return {2: (6, 6), 4: (1, 14)}.get(block, (2 * block - 1, 4 * block - 2))


def _occurrences(ids: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the blocks at ``starts`` occur: (number of the block, where) of every occurrence, and each start's block number.

    ``ids`` below zero stand in no block.  A word is written in base DIGIT, so that no node of the automaton has more children.
    """
    width, top = 1, int(ids.max()) + 2
    while DIGIT**width < top:
        width += 1
    spelt = np.stack([(ids + 1) // DIGIT**k % DIGIT for k in range(width)], axis=1).ravel().tolist()
    found, numbers, size = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}, block * width
    number_of = np.empty(len(starts), dtype=np.int64)
    for i, at in enumerate(starts.tolist()):
        key = tuple(spelt[at * width : at * width + size])
        number = numbers.get(key)
        if number is None:
            number = numbers[key] = len(numbers)
            found.add_word(key, number)
        number_of[i] = number
    found.make_automaton()
    n = len(ids)
    hits = np.fromiter((number * n + (end + 1) // width - block for end, number in found.iter(tuple(spelt)) if (end + 1) % width == 0), dtype=np.int64)
    return hits // n, hits % n, number_of


def seeds(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(s, d): an aligned block at s occurs again at s + d, and d fits the block's scale; one seed of neighbouring blocks with one d."""
    n, firsts, gaps = len(ids), [], []
    repeated = np.bincount(ids)[ids] > 1
    narrow = np.where(repeated, np.unique(np.where(repeated, ids, -1), return_inverse=True)[1] - (not repeated.all()), -1)
    block, alive = 2, repeated
    while 2 * block - 1 <= max(n // 2, LEAST):
        starts = np.arange(0, n - block + 1, block)
        starts = starts[alive[starts] & alive[starts + block // 2]]  # both halves occur again
        if not len(starts):
            break
        number, where, number_of = _occurrences(narrow, starts, block)
        low, high = distances(block)
        order = np.lexsort((starts, number_of))
        rank = number_of[order] * n + starts[order]  # blocks by number, then place
        base = number * n
        begin, end = np.searchsorted(rank, base + np.maximum(where - high, 0)), np.searchsorted(rank, base + where - low, side="right")
        count = np.where(where >= low, np.maximum(end - begin, 0), 0)
        hit = np.repeat(np.arange(len(count)), count)
        s = starts[order][np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count) + begin[hit]]
        d = where[hit] - s
        by = np.lexsort((s, d))
        s, d = s[by], d[by]
        first = np.ones(len(s), dtype=bool)
        first[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + block)  # a block right behind one with the same distance adds nothing
        firsts.append(s[first])
        gaps.append(d[first])
        alive = np.zeros(n, dtype=bool)
        alive[starts] = np.bincount(number, minlength=int(number_of.max()) + 1)[number_of] > 1
        block *= 2
    return (np.concatenate(firsts), np.concatenate(gaps)) if firsts else (np.zeros(0, dtype=np.int64),) * 2


def _reach(equal, most: np.ndarray) -> np.ndarray:
    """For each seed the largest k up to ``most`` for which ``equal(k)`` holds, by halving."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = equal(middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _extended(ids: np.ndarray, s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest stretch around each seed in which words d apart are equal, by prefix hashes."""
    n = len(ids)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(ids.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])

    def same(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (prefix[at + length] - prefix[at]) * power[d] == prefix[at + d + length] - prefix[at + d]

    right = _reach(lambda k: same(s, k), n - s - d)
    left = _reach(lambda k: same(s - k, k), s)
    return s - left, s + d + right


def _plain_extension(ids: np.ndarray, s: int, d: int) -> tuple[int, int]:
    start, end = s, s + d
    while start > 0 and ids[start - 1] == ids[start - 1 + d]:
        start -= 1
    while end < len(ids) and ids[end] == ids[end - d]:
        end += 1
    return start, end


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Every run as (start, length, period), by start, then period.

    Of the distances of one stretch the smallest is its period: the others are multiples of it.
    """
    if len(ids) < LEAST:
        return []
    s, d = seeds(ids)
    if not len(s):
        return []
    start, end = _extended(ids, s, d)
    long_enough = end - start >= np.maximum(LEAST, 2 * d)
    s, d, start, end = s[long_enough], d[long_enough], start[long_enough], end[long_enough]
    order = np.lexsort((d, end, start))
    s, d, start, end = s[order], d[order], start[order], end[order]
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    found = list(zip(s[fresh].tolist(), d[fresh].tolist(), start[fresh].tolist(), end[fresh].tolist(), strict=True))
    if all(np.array_equal(ids[a : b - q], ids[a + q : b]) for _, q, a, b in found):
        return sorted((a, b - a, q) for _, q, a, b in found)
    best: dict[tuple[int, int], int] = {}  # two prefix hashes met by chance: compare words from every seed
    s, d = seeds(ids)
    for at, q in zip(s.tolist(), d.tolist(), strict=True):
        a, b = _plain_extension(ids, at, q)
        if b - a >= max(LEAST, 2 * q):
            best[a, b] = min(q, best.get((a, b), q))
    return sorted((a, b - a, q) for (a, b), q in best.items())


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of the n words stay: all that no run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with the periodic tail that the checksum of the id asks for in a tenth of the documents; a null id asks for none."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def described(doc_id: int | None, text: str | None) -> tuple:
    """The row of one document."""
    words = planted(_WORD.findall(text or ""), doc_id)
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    found = runs(ids)
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
    kept = words if not found else [words[i] for i in np.flatnonzero(collapsed(len(words), found)).tolist()]
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return doc_id, len(found), *longest, listed, hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_runs, the longest run (start, length, period, exponent_milli) and digests of all runs and of the text without repeats.

    A run has 12 words and two periods or more.  A null or blank text has no words, no runs and digests of nothing; a text without
    runs four nulls.  Repeated rows each get a row, a null id keeps its text as it is, other columns are not read.  Empty table: no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(_COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind, _) in zip(columns, _COLUMNS, strict=True)], names=[name for name, _, _ in _COLUMNS])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(each, ", ".join(f"{name} {kind}" for name, _, kind in _COLUMNS))
