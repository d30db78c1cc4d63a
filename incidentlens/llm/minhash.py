"""MinHash near-duplicate detection with sequential Bayesian verification.

Steps, each a distributed table in the shared folder:

1. every document: its set of word shingles (whole text), a 128-bit key of that
   set and a MinHash signature; equal sets collapse to one *node*;
2. banding: nodes that share a band key are candidates.  ``bands`` follows from
   the threshold, the rows of a band and the chosen miss probability;
3. links within a bucket are first tried against the bucket's smallest node (a
   star), which joins most of a group of copies at a linear number of pairs; where
   many nodes of a bucket stay outside its largest component, other nodes of that
   component are centres of further stars;
4. pairs of a bucket that this left in *different* components are all compared,
   in blocks of bounded size, so a hot bucket is spread over tasks and no pair
   goes untried; two blocks of the largest component need not meet.  Blocks of
   many small buckets share a group;
5. every pair tried is compared batch by batch of its signature: it is pruned
   as soon as the posterior probability that its similarity reaches the
   threshold falls below the miss probability; survivors are confirmed on the
   full shingle sets.

Components need no pair whose ends are already joined, so copies are never
expanded into all pairs, and nothing about documents reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from incidentlens.llm import kernels as K
from incidentlens.llm.common import drop, materialize, maybe_broadcast
from incidentlens.llm.components import components

ROWS, STEP, BLOCK, BLOCK_BYTES, DEAL_BYTES = 5, 20, 512, 16 << 20, 8 << 20
#: Buckets with more nodes outside their largest component get up to STARS further stars before their pairs of blocks; the result is the same.
STARS, STAR_ROWS = 3, 8192


def bands_for(percent: int, miss: float, rows: int = ROWS) -> int:
    """Bands so that a pair exactly at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """MinHash signatures of non-empty sets, one row each."""
    out = np.empty((len(sets), len(factors)), dtype="<u4")
    if sets:
        flat = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        for j, factor in enumerate(factors):
            out[:, j] = np.minimum.reduceat((flat * factor) >> np.uint64(32), starts)
    return out


def least_matches(length: int, percent: int, miss: float) -> dict[int, int]:
    """By hashes compared: the fewest equal ones at which P(similarity >= threshold) is still ``miss``.

    Under a uniform prior the posterior after m of n is Beta(m+1, n-m+1), whose upper tail
    at t equals P(Binomial(n+1, t) <= m).
    """
    t, out = percent / 100, {}
    for n in sorted({*range(STEP, length + 1, STEP), length}):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def surviving(a: np.ndarray, b: np.ndarray, bounds: dict[int, int]) -> np.ndarray:
    """Indices of the signature pairs that no batch prunes."""
    alive, equal, at = np.arange(len(a)), np.zeros(len(a), dtype=np.int32), 0
    for n, least in bounds.items():
        if not len(alive):
            break
        equal = equal + (a[alive, at:n] == b[alive, at:n]).sum(axis=1, dtype=np.int32)
        keep = equal >= least
        alive, equal, at = alive[keep], equal[keep], n
    return alive


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int, factors: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = [K.lowered(x) for x in batch.column(1).to_pylist()]
            words, first = K.word_hashes(texts)
            sets = [K.shingles(words[first[i] : first[i + 1]], k) for i in range(len(texts))]
            full = [i for i, s in enumerate(sets) if len(s)]
            rows = signatures([sets[i] for i in full], factors)
            node, sig = [None] * len(sets), [None] * len(sets)
            for i, row in zip(full, rows, strict=True):
                node[i], sig[i] = K.set_key(sets[i]), row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "node", "sig"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, node binary, sig binary")


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u4").reshape(-1, width)


def _pruned(pairs: DataFrame, nodes: DataFrame, bounds: dict[int, int], width: int) -> DataFrame:
    """The pairs (a, b) that sequential comparison doesn't rule out."""

    def run(batches):
        for batch in batches:
            a, b = (_matrix(batch.column(i).to_pylist(), width) for i in (2, 3))
            keep = pa.array(surviving(a, b, bounds))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b")
    return joined.mapInArrow(run, "a binary, b binary")


_DEALT = "band int, key long, node binary, root binary, sig binary, own int, i int, j int, deal long"


def _segments(group: pd.DataFrame):
    """(rows, band, i, j) of every pair of blocks in a group."""
    keys = [group[c].to_numpy() for c in ("j", "i", "key", "band")]
    order = np.lexsort(keys)
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    for rows in np.split(order, np.flatnonzero(new)):
        at = rows[0]
        yield rows, int(keys[3][at]), int(keys[1][at]), int(keys[0][at])


def _tried(sig: np.ndarray, root: np.ndarray, own: np.ndarray, band: int, i: int, j: int, bounds: dict[int, int]):
    """Unpruned pairs (row, rows) of two blocks whose ends are in different components, each in its first shared band."""
    left = np.arange(len(own)) if i == j else np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own != i)
    for at, x in enumerate(left):
        against = right[at + 1 :] if i == j else right
        against = against[root[against] != root[x]]
        if not len(against):
            continue
        against = against[surviving(np.broadcast_to(sig[x], (len(against), sig.shape[1])), sig[against], bounds)]
        if len(against):
            before = (sig[against, : band * ROWS] == sig[x, : band * ROWS]).reshape(len(against), band, ROWS).all(axis=2).any(axis=1)
            against = against[~before]
            if len(against):
                yield int(x), against


def _mixed(buckets: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(members, sizes, scratch path of the sizes) of the buckets with nodes of two components or more.

    members: band, key, node, n, root; sizes: per bucket its largest root and rows and bytes of that and of the others.
    """
    labelled = buckets.select("band", "key", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = labelled.groupBy("band", "key", "root").agg(F.count("*").alias("rows"), F.sum(F.col("n") * 8).alias("bytes"))
    sizes = each.groupBy("band", "key").agg(
        F.max_by("root", F.struct("rows", "root")).alias("big"), F.max(F.struct("rows", "root", "bytes")).alias("top"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count("*").alias("roots"),
    ).where("roots > 1")
    sizes, sizes_at = materialize(sizes.select(
        "band", "key", "big", F.col("top.rows").alias("big_rows"), F.col("top.bytes").alias("big_bytes"),
        (F.col("rows") - F.col("top.rows")).alias("other_rows"), (F.col("bytes") - F.col("top.bytes")).alias("other_bytes"),
    ), "mixed", merge=True)
    return labelled, sizes, sizes_at


def _cross_links(labelled: DataFrame, sizes: DataFrame, docs: DataFrame, nodes: DataFrame, bounds: dict[int, int], width: int, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Links between different components of a bucket: a row for each pair of components that a pair of blocks joins.

    A bucket's largest component and its other nodes are dealt into blocks of bounded rows and bytes, and each
    pair of blocks but those of the largest component is compared, in groups that hold about DEAL_BYTES.
    The first pass, over signatures, finds the nodes with an unpruned pair;
    the second brings those nodes' full sets to the group and compares exactly.
    """
    blocks = lambda part: F.greatest(F.ceil(F.col(f"{part}_rows") / BLOCK), F.ceil(F.col(f"{part}_bytes") / BLOCK_BYTES)).cast("int").alias(f"{part}_blocks")
    sizes = sizes.select("*", blocks("big"), blocks("other"))
    copies = lambda unit: F.col(f"big_{unit}") * F.col("other_blocks") + F.col(f"other_{unit}") * (F.col("big_blocks") + F.col("other_blocks"))
    total = sizes.agg(F.coalesce(F.sum(copies("rows") * (width * 4 + 96) + copies("bytes")), F.lit(0))).first()[0]
    shape = sizes.select("band", "key", "big", "big_blocks", "other_blocks")
    placed = labelled.join(maybe_broadcast(shape, 64), ["band", "key"]).withColumn("in_big", F.col("root") == F.col("big"))
    own = F.when(F.col("in_big"), F.pmod(F.hash("node"), F.col("big_blocks"))).otherwise(F.col("big_blocks") + F.pmod(F.hash("node"), F.col("other_blocks")))
    others = F.sequence(F.when(F.col("in_big"), F.col("big_blocks")).otherwise(F.lit(0)), F.col("big_blocks") + F.col("other_blocks") - 1)
    dealt = placed.withColumn("own", own).withColumn("other", F.explode(others)).select("band", "key", "node", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    deal = F.pmod(F.xxhash64("band", "key", "i", "j"), F.lit(1 + total // DEAL_BYTES))
    dealt = dealt.join(nodes.select("node", "sig"), "node").select("band", "key", "node", "root", "sig", "own", "i", "j", deal.alias("deal"))

    def find(group: pd.DataFrame) -> pd.DataFrame:
        sig, root, own, kept = _matrix(group["sig"], width), pd.factorize(group["root"])[0], group["own"].to_numpy(), np.zeros(len(group), dtype=bool)
        for rows, band, i, j in _segments(group):
            for x, against in _tried(sig[rows], root[rows], own[rows], band, i, j, bounds):
                kept[rows[x]] = True
                kept[rows[against]] = True
        return group[kept]

    def confirm(group: pd.DataFrame) -> pd.DataFrame:
        sig, root, own = _matrix(group["sig"], width), pd.factorize(group["root"])[0], group["own"].to_numpy()
        sets, node, found = group["items"].to_numpy(), group["node"].to_numpy(), []
        for rows, band, i, j in _segments(group):
            joined: dict[int, int] = {}

            def top(x: int, joined=joined) -> int:
                while joined.get(x, x) != x:
                    x = joined[x]
                return x

            for x, against in _tried(sig[rows], root[rows], own[rows], band, i, j, bounds):
                for y in against:
                    a, b = top(int(root[rows[x]])), top(int(root[rows[y]]))
                    if a != b and _linked(*(np.frombuffer(sets[rows[z]], dtype="<u8") for z in (x, y)), percent):
                        joined[max(a, b)] = min(a, b)
                        found.append((node[rows[x]], node[rows[y]]))
        return pd.DataFrame(found, columns=["a", "b"])

    involved, involved_at = materialize(dealt.groupBy("deal").applyInPandas(find, _DEALT), "involved", merge=True)
    held, held_at = _sets(involved.select("node").distinct(), docs, nodes, id_col, text_col, k)
    full = involved.join(held, "node").groupBy("deal").applyInPandas(confirm, "a binary, b binary")
    links, _ = materialize(full, "cross", merge=True)
    for path in (involved_at, held_at):
        drop(docs.sparkSession, path)
    return links


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct items."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, str]:
    """(node, items): the full shingle sets of the wanted nodes, read again from their carriers' texts."""
    carriers, carriers_at = materialize(nodes.select("node", "doc_id").join(wanted, "node"), "carriers", merge=True)

    def sets(batches):
        for batch in batches:
            texts = [K.lowered(x) for x in batch.column(0).to_pylist()]
            words, first = K.word_hashes(texts)
            found = [K.shingles(words[first[i] : first[i + 1]], k) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([K.set_key(s) for s in found], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())],
                names=["node", "items"],
            )

    ids = carriers.select("doc_id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.where("doc_id is not null").join(maybe_broadcast(ids, 16), "doc_id").select("text")
    held = materialize(texts.mapInArrow(sets, "node binary, items binary").dropDuplicates(["node"]), "sets")
    drop(docs.sparkSession, carriers_at)
    return held


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs that are links by their full sets."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    held, held_at = _sets(wanted, docs, nodes, id_col, text_col, k)

    def confirm(batches):
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = pa.array([_linked(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8"), percent) for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = held.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = held.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b")
    links, _ = materialize(joined.mapInArrow(confirm, "a binary, b binary"), "links", merge=True)
    drop(docs.sparkSession, held_at)
    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80,
    miss: float = 1e-6, seed: int = 20240607, with_node: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept; with ``with_node`` also node, the key of its shingle set.

    Null, empty or blank text: no shingles, its own component, kept.  Fewer words than ``shingle``: the
    whole sequence is one shingle.  Equal ids are one document of the components; repeated rows each
    get a row.  A null id joins no others: its row takes the component of the named documents with an equal
    set, else null, and is never kept.  Only ``id_col`` and ``text_col`` are read, so other columns may have any name.
    """
    bands = bands_for(percent, miss)
    width = bands * ROWS
    bounds = least_matches(width, percent, miss)
    spark = docs.sparkSession
    rows, rows_at = materialize(_fingerprints(docs, id_col, text_col, shingle, multipliers(width, seed)), "fingerprints")
    # A text without an id never carries its node's text: such a node is joined only through equality.
    nodes, nodes_at = materialize(
        rows.where("node is not null and doc_id is not null").groupBy("node", F.col("n_shingles").alias("n"), "sig").agg(F.min("doc_id").alias("doc_id"))
        .withColumn("h", F.xxhash64("node")), "nodes"
    )  # a node has one signature: as keys they keep the aggregate a hash aggregate
    keys = F.array(*[
        F.struct(F.lit(j).alias("band"), F.xxhash64(F.substring("sig", j * ROWS * 4 + 1, ROWS * 4)).alias("key")) for j in range(bands)
    ])
    # Nodes go by the 8 bytes of h here: rows are short and of fixed width.  Should two nodes share an h, more pairs are tried.
    banded = nodes.select("h", F.inline(keys))
    shared = banded.groupBy("band", "key").agg(F.min("h").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets, buckets_at = materialize(banded.join(shared, ["band", "key"]).join(nodes.select("h", "node", "n"), "h"), "buckets")

    def star(pairs: DataFrame) -> DataFrame:
        tried, tried_at = materialize(_pruned(pairs, nodes, bounds, width), "stars", merge=True)
        links = _confirmed(tried, docs, nodes, id_col, text_col, shingle, percent)
        drop(spark, tried_at)
        return links

    least = nodes.select(F.col("h").alias("least"), F.col("node").alias("a"))
    first = buckets.where("h != least").select("least", F.col("node").alias("b")).distinct().join(least, "least").select("a", "b")
    roots, roots_at = components(star(first))
    for turn in range(STARS + 1):
        labelled, sizes, sizes_at = _mixed(buckets, roots)
        wide = sizes.where(F.col("other_rows") > STAR_ROWS).select("band", "key", "big")
        if turn == STARS or wide.isEmpty():
            break
        within = labelled.join(maybe_broadcast(wide, 48), ["band", "key"])
        centres = within.where("root = big").groupBy("band", "key").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("a"))
        more = within.where("root != big").join(centres, ["band", "key"]).select("a", F.col("node").alias("b")).distinct()
        further = roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(star(more).select("a", "b"))
        before_at = roots_at
        roots, roots_at = components(further)
        drop(spark, before_at)
        drop(spark, sizes_at)
    cross_links = _cross_links(labelled, sizes, docs, nodes, bounds, width, id_col, text_col, shingle, percent)

    # Rows that repeat an id with another text join their nodes too: they are one document.
    same_id = rows.where("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    repeated = rows.join(same_id.select("doc_id", "a"), "doc_id").where("node != a").select("a", F.col("node").alias("b"))
    joined = roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(cross_links.select("a", "b")).union(repeated)
    final, _ = components(joined)

    rooted = nodes.select("node", "doc_id").join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("node", "component_id")
    for path in (buckets_at, roots_at, sizes_at):
        drop(spark, path)  # ``final`` is written; only ``rows`` and ``nodes`` are still read
    out = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"), *["node"] * with_node,
    )


def keyed(docs: DataFrame, text_col: str = "text", *, shingle: int = 5) -> DataFrame:
    """``docs`` with a last column _node: the key of the row's shingle set, null if its text has no words."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [K.lowered(x) for x in batch.column(at).to_pylist()]
            words, first = K.word_hashes(texts)
            sets = [K.shingles(words[first[i] : first[i + 1]], shingle) for i in range(len(texts))]
            node = pa.array([K.set_key(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, node], names=[*batch.schema.names, "_node"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_node", BinaryType())]))
