"""Benchmark decontamination with SimHash over item-sized windows.

For every benchmark item, each run of as many words in a document is a window.
Windows and items are compared as weighted sets of word shingles; a shingle
weighs the logarithm of its rarity among all items, in however many passes they are compared.

A window that reaches the threshold shares one of the item's rarest shingles, those that
together weigh more than the item may lack; fingerprints are built around such *anchors*
only, which loses nothing.  A fingerprint has 128 bits in 16 blocks.  An index maps, per
length, block and value, to the items within 2 bits there: two fingerprints that differ in
at most ``RADIUS`` = 44 bits differ in more than 2 bits in at most 14 blocks, so every item
within the radius is listed for two blocks or more, and only such items are measured.  At the
lowest similarity of interest, 0.8, the expected distance is 19 bits with a
standard deviation of 4.  What the index finds is confirmed exactly.

(At this radius a list holds a seventh of the items of its length: blocks short enough to
list neighbours of cannot be more selective.  What spares work is the anchors.)
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm import kernels as K
from incidentlens.llm.common import materialize

BITS, BLOCKS, BLOCK_RADIUS, RADIUS = 128, 16, 2, 44
#: Blocks in which two fingerprints within RADIUS differ by BLOCK_RADIUS bits at most.
LEAST_BLOCKS = BLOCKS - RADIUS // (BLOCK_RADIUS + 1)
#: Windows fingerprinted at once: what memory a document takes doesn't grow with its text.
PIECE_WINDOWS = 8192
#: Weights are whole multiples of this, so that sums, and so fingerprints, don't depend on where a piece begins.
UNIT = 2.0**-36
#: Benchmark text that one pass over the documents compares with; a larger benchmark takes more passes.
PASS_BYTES, SCREEN_BITS = 4 << 20, 1 << 26


def _bits(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle, BITS columns."""
    words = np.stack([hashes, K.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


class Items:
    """The benchmark of one pass: fingerprints, block index and exact sets.

    ``corpus`` has the statistics of a benchmark of several passes; without it, ``rows`` are the whole benchmark.
    """

    def __init__(self, rows: list[tuple[int, str | None]], k: int, threshold: float, corpus: tuple[int, np.ndarray, np.ndarray] | None = None):
        words, first = K.word_hashes([K.lowered(t) for _, t in rows])
        kept = [(i, words[first[n] : first[n + 1]]) for n, (i, _) in enumerate(rows) if first[n + 1] > first[n]]
        self.k, self.threshold, self.ids = k, threshold, [i for i, _ in kept]
        self.length = np.array([len(w) for _, w in kept], dtype=np.int64)
        self.sets = [K.shingles(w, k) for _, w in kept]
        known, df = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *self.sets]), return_counts=True)
        total, self.common, df = corpus or (len(kept), known[df > 1], df[df > 1])
        self.common_weight = np.round(np.log(1 + total / df) / UNIT) * UNIT
        self.other = round(math.log(1 + total) / UNIT) * UNIT  # of a shingle that one item has, or none
        self.anchors = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *map(self._anchors, self.sets)]))
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.anchors & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        sums = [(_bits(s) * self.units(s)[:, None]).sum(axis=0) for s in self.sets]
        self.prints = np.array([np.packbits(x > 0) for x in sums], dtype=np.uint8).reshape(-1, BLOCKS)
        self.by_length = {int(n): np.flatnonzero(self.length == n) for n in np.unique(self.length)}
        self._index: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # built where it is used, not sent

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.full(len(hashes), self.other)
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        return np.where(self.common[at] == hashes, self.common_weight[at], self.other)

    def units(self, hashes: np.ndarray) -> np.ndarray:
        return (self.weights(hashes) / UNIT).astype(np.int64)

    def _anchors(self, own: np.ndarray) -> np.ndarray:
        """The rarest shingles of an item that weigh more than a window at the threshold may lack of it."""
        weight = self.weights(own)
        order = np.lexsort((own, -weight))
        sums = np.cumsum(weight[order])
        return own[order[: int(np.searchsorted(sums, (1 - self.threshold) * sums[-1] + 1e-6, side="right")) + 1]]

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the shingles that are some item's anchors."""
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.anchors):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.anchors, hashes[maybe]), len(self.anchors) - 1)
        return maybe[self.anchors[at] == hashes[maybe]]

    def index(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of the items of n words, per block: (begin of each value's list, lists of items within BLOCK_RADIUS bits of the value)."""
        if n not in self._index:
            values, tables = np.arange(256, dtype=np.uint8), []
            for own in self.prints[self.by_length[n]].T:
                value, item = np.nonzero(np.bitwise_count(values[:, None] ^ own[None, :]) <= BLOCK_RADIUS)
                tables.append((np.searchsorted(value, np.arange(257)), item.astype(np.int32)))
            self._index[n] = tables
        return self._index[n]

    def within_radius(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of every pair of a window's fingerprint and an item of n words within RADIUS."""
        group, found = self.by_length[n], []
        step = max(1, (1 << 21) // len(group))
        for lo in range(0, len(prints), step):
            part, listed = prints[lo : lo + step], []
            for block, (begin, items) in enumerate(self.index(n)):
                value = part[:, block].astype(np.int64)
                size = begin[value + 1] - begin[value]
                window = np.repeat(np.arange(len(part)), size)
                place = np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[value], size)
                listed.append(window * len(group) + items[place])
            times = np.bincount(np.concatenate(listed))
            window, item = np.divmod(np.flatnonzero(times >= LEAST_BLOCKS), len(group))
            distance = np.bitwise_count(part[window] ^ self.prints[group[item]]).sum(axis=1, dtype=np.int64)
            near = distance <= RADIUS
            found.append((window[near] + lo, group[item[near]], distance[near]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's."""
        own, theirs = np.unique(window), self.sets[item]
        both = self.weights(np.intersect1d(own, theirs, assume_unique=True)).sum()
        either = self.weights(own).sum() + self.weights(theirs).sum() - both
        return float(both / either) if either else 0.0

    def matches(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """By item: (similarity, first word, words) of the document's best window, ties to the first one."""
        found: dict[int, tuple[float, int, int]] = {}
        for k in {min(self.k, n, len(words)) for n in self.by_length} - {0}:
            hashes = K.window_hashes(words, k)
            hits = self.hits(hashes)
            if not len(hits):
                continue
            sizes = [n for n in self.by_length if min(self.k, n, len(words)) == k]
            reach = max(sizes)
            cut = np.flatnonzero(np.diff(hits) > 2 * reach) + 1
            for group in np.split(hits, cut):
                end = int(group[-1]) + 1
                for lo in range(max(0, int(group[0]) - reach), end, PIECE_WINDOWS):
                    hi = min(len(hashes), lo + PIECE_WINDOWS + reach)  # windows begin in the piece and may end beyond it
                    own = group[np.searchsorted(group, lo) : np.searchsorted(group, hi)]
                    if len(own):
                        self._region(hashes[lo:hi], lo, own - lo, k, sizes, len(words), found)
        return found

    def _region(self, part, lo, hits, k, sizes, n_words, found) -> None:
        vectors = _bits(part) * self.units(part)[:, None]
        total = np.zeros((len(part) + 1, BITS), dtype=np.int64)
        np.cumsum(vectors, axis=0, out=total[1:])
        order = np.argsort(part, kind="stable")
        same = part[order[1:]] == part[order[:-1]]
        again = order[:-1][same], order[1:][same]  # (place of a shingle, its next place)
        mark = np.zeros(len(part) + 1, dtype=np.int64)
        mark[hits + 1] = 1
        count = np.cumsum(mark)
        for n in sizes:
            span = min(n, n_words) - k + 1  # shingles in a window
            if span > len(part):
                continue
            starts = np.flatnonzero(count[span:] - count[:-span] > 0)
            starts = starts[starts < PIECE_WINDOWS]
            if not len(starts):
                continue
            sums = total[starts + span] - total[starts]
            twice = again[1] - again[0] < span
            if twice.any():
                sums -= _repeats(vectors, again[0][twice], again[1][twice], span)[starts]
            at, which, distance = self.within_radius(n, np.packbits(sums > 0, axis=1))
            for i in np.lexsort((at, distance)):
                s, item = int(starts[at[i]]), int(which[i])
                best = found.get(item)
                if best is not None and best[0] == 1.0 and best[1] <= lo + s:
                    continue  # none is more similar
                value = self.similarity(part[s : s + span], item)
                if value >= self.threshold and (best is None or (-value, lo + s) < (-best[0], best[1])):
                    found[item] = (value, lo + s, min(n, n_words))


def _repeats(vectors: np.ndarray, one: np.ndarray, following: np.ndarray, span: int) -> np.ndarray:
    """By first shingle of a window: what its sum counts too often, a window being a set.

    A pair of neighbouring places of one shingle lies in the windows that begin after ``following - span`` and not after ``one``.
    """
    change = np.zeros((len(vectors) + 1, BITS), dtype=np.int64)
    np.add.at(change, np.maximum(0, following - span + 1), vectors[one])
    np.subtract.at(change, one + 1, vectors[one])
    return np.cumsum(change, axis=0, out=change)


def _statistics(rows: DataFrame, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Of all items: how many have words, the shingles that two or more have, in order, and how many have each.

    A shingle of one item weighs what an unknown one does, so these are all the weights that any pass needs.
    """

    def run(batches):
        for batch in batches:
            words, first = K.word_hashes([K.lowered(x) for x in batch.column(1).to_pylist()])
            sets = [K.shingles(words[first[i] : first[i + 1]], k).view(np.int64) for i in range(batch.num_rows) if first[i + 1] > first[i]]
            if sets:  # a null for each item counts the items
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(len(sets), pa.int64()), pa.array(np.concatenate(sets))])], names=["shingle"])

    found = rows.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("shingle is null or n > 1").toArrow()
    shingle, n = found.column(0).combine_chunks(), found.column(1).to_numpy()
    null = shingle.is_null().to_numpy(zero_copy_only=False)
    common, df = shingle.drop_null().to_numpy().view(np.uint64), n[~null]
    order = np.argsort(common)
    return int(n[null].sum()), common[order], df[order]


def _passes(parts: list[DataFrame], k: int, threshold: float, whole: DataFrame):
    """The items of each pass in turn, all with the weights of the whole benchmark."""
    corpus = _statistics(whole, k) if len(parts) > 1 else None
    for part in parts:
        yield Items([tuple(r) for r in part.collect()], k, threshold, corpus)  # PASS_BYTES at most


def _slices(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // PASS_BYTES))
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


class Screen:
    """A bit per shingle hash of the whole benchmark, at most SCREEN_BITS: a document without any holds no item.

    A benchmark of several passes is screened for in one scan, so that its passes read only the documents that are left.
    """

    def __init__(self, rows: DataFrame, k: int, n_bits: int = 0):
        self.k, self.bits = k, np.zeros((n_bits or SCREEN_BITS) // 8, dtype=np.uint8)

        def run(batches):
            for batch in batches:
                words, first = K.word_hashes([K.lowered(x) for x in batch.column(1).to_pylist()])
                sets = [self._places(words[first[i] : first[i + 1]], ()) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(sets)))], names=["place"])

        for batch in rows.mapInArrow(run, "place long").distinct().toLocalIterator(prefetchPartitions=False):
            self.bits[batch[0] >> 3] |= np.uint8(1 << (batch[0] & 7))

    def _places(self, words: np.ndarray, shorter) -> np.ndarray:
        """Places of its shingles; a document is also cut into the shingles of items with fewer than k words."""
        sizes = {min(self.k, len(words)), *(n for n in shorter if n <= len(words))} - {0}
        hashes = [K.window_hashes(words, n) for n in sizes]
        return (np.concatenate([np.zeros(0, dtype=np.uint64), *hashes]) & np.uint64(8 * len(self.bits) - 1)).astype(np.int64)

    def holds(self, words: np.ndarray) -> bool:
        at = self._places(words, range(1, self.k))
        return bool(((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).any())


def _screened(docs: DataFrame, text_col: str, screen: Screen, keep: bool) -> DataFrame:
    """The rows that may hold an item (``keep``), or the others."""
    shared, at = docs.sparkSession.sparkContext.broadcast(screen), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            words, first = K.word_hashes([K.lowered(x) for x in batch.column(at).to_pylist()])
            mask = [shared.value.holds(words[first[i] : first[i + 1]]) == keep for i in range(batch.num_rows)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    *, shingle: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """One row per input row and item it contains: doc_id, item_id, similarity, first_word, n_words.

    Words are those of the near-duplicate operators.  An item of fewer words than ``shingle`` is one
    shingle; a null, empty or blank item or document matches nothing.  A document shorter than an item
    is one window.  Repeated rows of documents each report; equal items each report.  A null id is
    reported as null.  Either table empty: no rows.
    """
    parts, whole = _slices(benchmark, item_col, item_text_col), benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    source, out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), None
    if len(parts) > 1:
        source, _ = materialize(_screened(source, "text", Screen(whole, shingle), True), "screened")
    for items in _passes(parts, shingle, threshold, whole):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                words, first = K.word_hashes([K.lowered(x) for x in batch.column(1).to_pylist()])
                rows = []
                for i, doc_id in enumerate(batch.column(0).to_pylist()):
                    for item, (value, start, n) in sorted(items.matches(words[first[i] : first[i + 1]]).items()):
                        rows.append((doc_id, items.ids[item], value, start, n))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"]
                )

        found = source.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = found if out is None else out.union(found)
    return out


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, shingle: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; every other row stays as it is.

    The flag is computed beside the row, so neither a join nor a shuffle is needed; columns stay.
    """
    parts, whole = _slices(benchmark, item_col, item_text_col), benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    kept, at = docs, docs.columns.index(text_col)
    if len(parts) > 1:
        screen = Screen(whole, shingle)
        kept, _ = materialize(_screened(docs, text_col, screen, True), "screened")
    for items in _passes(parts, shingle, threshold, whole):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared, at=at):
            for batch in batches:
                words, first = K.word_hashes([K.lowered(x) for x in batch.column(at).to_pylist()])
                keep = [not shared.value.matches(words[first[i] : first[i + 1]]) for i in range(batch.num_rows)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept if len(parts) == 1 else kept.union(_screened(docs, text_col, screen, False))
