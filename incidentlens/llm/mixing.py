"""Mixing sources to target weights by drawing fixed-length blocks.

1. A source's documents are laid end to end in a pseudorandom but fixed order
   and cut into blocks of ``block`` words; running positions come from two
   levels of sums, so a source with a third of all rows is spread over buckets.
2. Targets are filled up by weight under a cap of ``max_repeats`` times a
   source's size.
3. Every output shard draws how many of its slots each source gets: one multinomial over the
   sources, by what each still lacks of its target.  A source's words are what the draws
   gave it, in total near its target: only the last shard's draw stays uncorrected.
4. The running sum of a source's counts names its slots; its k-th slot holds block ``permute(k mod blocks)`` under a keyed
   Feistel permutation of its indices, a new key for each pass over the source,
   and slots join blocks by (source, index).

Sources are a table like any other: their numbers, weights, targets and draws are
computed in it, and only sums over it come to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.llm.common import materialize, maybe_broadcast

BLOCK, BUCKETS, RUN, SHARDS, MAX_REPEATS, SEED = 64, 1024, 4096, 64, 3, 20240611
#: Sources that one task draws for; over them, groups of sources draw first.
GROUP = 4096


def _key(source, epoch: int, seed: int) -> int:
    name = b"\x00" if source is None else b"\x01" + source.encode()
    return int.from_bytes(hashlib.blake2b(name + b"|%d|%d" % (epoch, seed), digest_size=8).digest(), "little")


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n): four Feistel rounds on the next even power of two, walking cycles back into range."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, at = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.ones(len(at), dtype=bool)
    while todo.any():
        left, right = at[todo] >> np.uint64(half), at[todo] & mask
        for r in range(4):
            f = (right + np.uint64((key >> 7 * r) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ ((f >> np.uint64(33)) & mask)
        at[todo] = (left << np.uint64(half)) | right
        todo = at >= np.uint64(n)
    return at.astype(np.int64)


def draw_counts(goals: np.ndarray, caps: np.ndarray, totals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(sources, shards): how many of its ``totals`` slots each shard draws of each source.

    A shard's counts are multinomial, with chances in proportion to what sources lack of their ``goals`` after the shards
    before.  No source gets more than its cap in all: what it can't take is drawn again among the others.
    """
    out, given = np.zeros((len(goals), len(totals)), dtype=np.int64), np.zeros(len(goals), dtype=np.int64)
    for shard, left in enumerate(totals.tolist()):
        while left:
            lacking = np.where(given < caps, np.maximum(goals - given, 0.0), 0.0)
            if not lacking.sum():  # all have what they asked for
                lacking = np.where(given < caps, goals, 0.0)
                if not lacking.sum():
                    break
            got = np.minimum(rng.multinomial(left, lacking / lacking.sum()), caps - given)
            out[:, shard] += got
            given += got
            left -= int(got.sum())
    return out


def shard_totals(slots: int, shards: int) -> np.ndarray:
    """Slots of each output shard: at most one apart."""
    return np.diff(np.arange(shards + 1, dtype=np.int64) * slots // shards)


def cyclic_weight(source: Column, number: Column) -> Column:
    """1, 2, 3, repeating, over sources in code point order with null last."""
    return 1 + number % 3


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` (source, ...) with number: 0 and up in code point order, null last.  Two levels, no global sort in one task."""
    ranged, _ = materialize(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranged")
    starts, at = [], 0
    for part, n in sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect()):  # as many as partitions
        starts.append((part, at))
        at += n
    starts = F.broadcast(sources.sparkSession.createDataFrame(starts, "part int, start long"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("number", within - 1).join(starts, "part").withColumn("number", F.col("start") + F.col("number")).drop("part", "start")


def filled(sources: DataFrame, cap: float = MAX_REPEATS) -> DataFrame:
    """``sources`` (size, weight, ...) with target: all sizes' sum shared by weight; no target passes ``cap`` times its size,
    and what it can't take is reshared.

    The share of a weight of 1 grows as sources reach their caps; each step is one sum over the table, and it ends when no other does.
    """
    limit = F.col("size") * float(cap)
    total, weight = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    share, capped = (total / weight if weight else 0.0), 0
    while weight:
        full = limit <= share * F.col("weight")
        taken, open_, n = sources.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(full.cast("long")), F.lit(0))
        ).first()
        if n == capped or not open_:
            break
        share, capped = (total - taken) / open_, n
    return sources.withColumn("target", F.least(limit, share * F.col("weight")))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """doc_id, source, size, bucket, tie: everything a position needs; the text itself goes no further."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))
    tie = F.xxhash64(F.lit(seed), F.col(id_col), text)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.cast("long").alias("size"), tie.alias("tie")
    ).withColumn("bucket", F.pmod("tie", F.lit(BUCKETS)).cast("int"))


_FACTS = "source_no long, source string, source_size long, target double, blocks long, slots long, ends array<long>"


class Mix:
    """A planned mix: ``facts`` (a row per source), ``placed`` (rows with their start) and ``slots``."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, block: int, shards: int, max_repeats: int, seed: int):
        self.spark, self.block, self.seed = docs.sparkSession, block, seed
        rows, _ = materialize(_sized(docs, id_col, text_col, source_col, seed), "sized")
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        sources = numbered(rows.groupBy("source").agg(F.sum("size").alias("size")))
        sources, _ = materialize(sources.withColumn("weight", weights(F.col("source"), F.col("number")).cast("double")), "weights")

        blocks = F.ceil(F.col("size") / block)
        wanted = filled(sources, max_repeats).select("number", "source", "size", "target", blocks.alias("blocks"))
        # As many slots as hold the target's words, at the source's mean length of a block (its last one is shorter).
        wanted = wanted.withColumn("goal", F.when(F.col("size") > 0, F.col("target") * F.col("blocks") / F.col("size")).otherwise(0.0)).withColumn("bundle", F.floor(F.col("number") / GROUP))
        wanted, _ = materialize(wanted, "wanted")
        self.facts, _ = materialize(self._drawn(wanted, shards, max_repeats), "facts")
        self.placed = self._placed(rows, sums)

    def _drawn(self, wanted: DataFrame, shards: int, max_repeats: int) -> DataFrame:
        """The sources with their slots; ``ends`` are the running sums of their counts over the shards.

        A multinomial over many sources is drawn in two steps: over bundles of GROUP sources here (a row per bundle), then in each bundle by a task.
        """
        seed = self.seed
        bundles = sorted(map(tuple, wanted.groupBy("bundle").agg(F.sum("goal"), F.sum(F.col("blocks") * max_repeats)).collect()))
        goals, caps = np.array([b[1] for b in bundles], dtype=np.float64), np.array([b[2] for b in bundles], dtype=np.int64)
        counts = draw_counts(goals, caps, shard_totals(round(float(goals.sum())), shards), np.random.default_rng(_key("bundles", -1, seed)))
        shares = self.spark.createDataFrame([(b[0], c.tolist()) for b, c in zip(bundles, counts, strict=True)], "bundle long, totals array<long>")

        def draw(rows):
            rows = rows.sort_values("number")
            rng = np.random.default_rng(_key("bundle", int(rows["bundle"].iloc[0]), seed))
            counts = draw_counts(rows["goal"].to_numpy(), rows["blocks"].to_numpy() * max_repeats, np.array(rows["totals"].iloc[0]), rng)
            out = rows[["number", "source", "size", "target", "blocks"]].set_axis(["source_no", "source", "source_size", "target", "blocks"], axis=1)
            return out.assign(slots=counts.sum(axis=1), ends=list(np.cumsum(counts, axis=1)))

        return wanted.join(shares, "bundle").groupBy("bundle").applyInPandas(draw, _FACTS)

    def _placed(self, rows: DataFrame, sums: DataFrame) -> DataFrame:
        """Where every document begins in its source: the sum of the buckets before, then of the rows before."""
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        begins = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
        within = Window.partitionBy("source", "bucket").orderBy("tie", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        inner = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        placed = inner.join(begins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("base") + F.col("inner"))
        facts = self.facts.select("source_no", F.col("source").alias("s"), "source_size", "target")
        return placed.select("doc_id", "tie", "source", "size", "start").join(maybe_broadcast(facts, 256), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def slots(self) -> DataFrame:
        """Every slot of the mix: source_no, block, shard.  Slots of a source go to the shards in turn of its draws."""
        seed = self.seed

        def run(batches):
            for batch in batches:
                for no, source, n, total, ends, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    k = np.arange(at, min(total, at + RUN))
                    block = np.empty(len(k), dtype=np.int64)
                    for epoch in np.unique(k // n):
                        own = k // n == epoch
                        block[own] = permute(k[own] % n, n, _key(source, int(epoch), seed))
                    shard = np.searchsorted(np.array(ends), k, side="right").astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), no, dtype=np.int64)), pa.array(block), pa.array(shard)], names=["source_no", "block", "shard"])

        runs = self.facts.where("slots > 0").select("source_no", "source", "blocks", "slots", "ends", F.explode(F.expr(f"sequence(0L, slots - 1, {RUN}L)")).alias("at"))
        # A run is a small row that grows to RUN slots: its partitions are counted here, not coalesced by bytes.
        total = self.facts.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
        parts = max(1, min(10_000, -(-total // (16 * RUN))))
        return runs.repartition(parts, "source_no", "at").mapInArrow(run, "source_no long, block long, shard int")

    def covered(self) -> DataFrame:
        """Every row with the blocks that it lies in and its words there: source_no, start, block, words."""
        b = self.block
        each = self.placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
        words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b)
        return each.select("source_no", "start", "block", words.alias("words"))

    def taken(self) -> DataFrame:
        """Every input row: doc_id, tie, source, size, source_size, target, taken."""
        times = self.slots().groupBy("source_no", "block").agg(F.count("*").alias("times"))
        # Spark would take the slots, which come from a few rows, for few: the hint keeps them from a broadcast.
        taken = self.covered().join(times.hint("merge"), ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(F.col("times") * F.col("words")).alias("taken"))
        taken = taken.select(F.col("source_no").alias("n"), F.col("start").alias("at"), "taken")
        joined = self.placed.join(taken, (F.col("source_no") == F.col("n")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left")
        return joined.select("doc_id", "tie", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=cyclic_weight,
    block: int = BLOCK, shards: int = SHARDS, max_repeats: int = MAX_REPEATS, seed: int = SEED,
) -> Mix:
    """Plans a mix of ``docs``.

    ``weights`` makes a positive number of the columns (source, its number in code point order, null last).  Null or blank
    text: size 0, nothing taken.  A null source is a source of its own.  Repeated rows are laid out one
    after the other, each with its own words.  An empty table gives no rows.
    """
    return Mix(docs, id_col, text_col, source_col, weights, block, shards, max_repeats, seed)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row repeated as the mix takes it: taken / size copies, its fraction rounded by a
    uniform hash of the row, so that a source keeps its share.  Columns stay, whatever their names; a row without words is kept once."""
    planned = plan(docs, id_col, text_col, source_col, **options)
    rate = F.avg(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1.0))
    copies = planned.taken().groupBy(F.col("doc_id").alias("id"), "tie").agg(rate.alias("rate"))
    chance = F.pmod(F.xxhash64(F.lit(planned.seed + 1), "tie", "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = copies.select("id", "tie", F.floor(F.col("rate") + chance).cast("int").alias("copies")).where("copies > 0")
    copies, _ = materialize(copies, "copies")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.lit(planned.seed), F.col(id_col), text).alias("own_tie"), F.col(id_col).cast("long").alias("own_id"))
    joined = keyed.join(maybe_broadcast(copies, 32), (F.col("own_tie") == F.col("tie")) & F.col("own_id").eqNullSafe(F.col("id")))
    return joined.select("row", F.explode(F.expr("sequence(1, copies)"))).select("row.*")
