"""Sharding over fixed virtual slots, by DataFrame operations only.

Texts hash into a fixed number of virtual slots; bytes are summed per slot; a
versioned map sends slots to shards and is *edited* when it is rebalanced, so
that only the rows of moved slots change place.  The map has ``slots`` rows
whatever the data, which is why it may be collected and broadcast.  Its versions
are stored, a file each: a run reads the last one, edits it and stores what it changed as the next.

One rule places rows at every size of table: a text's copies go together in pieces of
about ``COPIES``.  Up to that many share a slot; of more, the id (and, for equal
rows, their number) decides the piece.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentlens.llm.common import materialize, maybe_broadcast
from incidentlens.operators.commits import Files

SLOTS, PARTS, COPIES = 4096, 8, 64


def initial_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots dealt out in turn."""
    return [slot % shards for slot in range(slots)]


def rebalanced(owner: list[int], weight: list[int], shards: int) -> list[int]:
    """Edits the map: while it helps, a slot goes from the heaviest shard that can give one to the lightest.

    It moves the slot nearest to half the gap and below the gap, so every move lowers the sum of squares
    and the loop ends.  Ties: the lowest shard, the lowest slot.
    """
    owner = list(owner)
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        load[shard] += weight[slot]
        if weight[slot]:
            held[shard].append(slot)
    while True:
        low = min(range(shards), key=lambda s: (load[s], s))
        for high in sorted(range(shards), key=lambda s: (-load[s], s)):
            gap = load[high] - load[low]
            fit = [slot for slot in held[high] if weight[slot] < gap]
            if fit:
                break
        else:
            return owner
        slot = min(fit, key=lambda s: (abs(2 * weight[s] - gap), s))
        held[high].remove(slot)
        held[low].append(slot)
        owner[slot] = low
        load[high] -= weight[slot]
        load[low] += weight[slot]


def grown(owner: list[int], weight: list[int], shards: int) -> list[int]:
    """Edits the map for one more shard: slots move only into the new one, from whichever is heaviest."""
    owner, load = list(owner), [0] * (shards + 1)
    for slot, shard in enumerate(owner):
        load[shard] += weight[slot]
    target = sum(load) // (shards + 1)
    for slot in sorted(range(len(owner)), key=lambda s: (-weight[s], s)):
        shard = owner[slot]
        if load[shards] + weight[slot] <= target and load[shard] == max(load[:shards]):
            owner[slot] = shards
            load[shard] -= weight[slot]
            load[shards] += weight[slot]
    return owner


def write_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> bool:
    """Stores a version as a file of its own unless there is one by that number; whether it did.  Earlier ones stay readable."""
    files = Files(spark, path)
    return files.create(files.at(f"{version:08d}.json"), json.dumps(owner))


def read_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]] | None:
    """(version, owners by slot): the latest version by default; None where no map is."""
    files = Files(spark, path)
    if version is None:
        version = max((int(n[:-5]) for n in files.names(files.folder) if n.endswith(".json") and n[:-5].isdigit()), default=-1)
    return (version, json.loads(files.read(files.at(f"{version:08d}.json")))) if version >= 0 else None


def edited_map(spark: SparkSession, path: str, weight: list[int], shards: int) -> list[int]:
    """The last stored version rebalanced for ``weight``; a change is stored as the next version.

    Whoever stores a version second edits the one that came first.
    """
    while True:
        stored = read_map(spark, path)
        if stored is None:
            write_map(spark, path, 0, initial_map(shards, len(weight)))
            continue
        version, owner = stored
        if len(owner) != len(weight) or max(owner) >= shards:
            raise ValueError(f"the map at {path} has {len(owner)} slots and {max(owner) + 1} shards, not {len(weight)} and {shards}")
        changed = rebalanced(owner, weight, shards)
        if changed == owner or write_map(spark, path, version + 1, changed):
            return changed


def virtual_slots(rows: DataFrame, slots: int = SLOTS, copies: int = COPIES) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, group, times) one by one, with ``vslot`` and ``part``.

    A text with more than ``copies`` rows is cut into that many fewer pieces, each with a slot of its own.
    ``part`` cuts a slot's rows by id into PARTS, so that numbering them is never one task's work.
    """
    groups = rows.groupBy("group").agg(F.sum("times").alias("n")).where(F.col("n") > copies)
    pieces = groups.select("group", F.ceil(F.col("n") / copies).alias("pieces"))
    each = rows.join(maybe_broadcast(pieces, 24), "group", "left").withColumn("copy", F.explode(F.expr("sequence(1L, times)")))
    by_id = F.xxhash64("doc_id", F.floor(F.col("copy") / copies))
    piece = F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(by_id, F.col("pieces")))
    part = F.pmod(F.shiftrightunsigned(F.xxhash64("group", "doc_id"), 24), F.lit(PARTS))
    carried = [c for c in rows.columns if c not in ("group", "times")]
    return each.select(*carried, F.pmod(F.xxhash64("group", piece.cast("long")), F.lit(slots)).cast("int").alias("vslot"), part.cast("int").alias("part"))


def shard_rows(
    docs: DataFrame, map_path: str, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 8, slots: int = SLOTS, carry: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, and the column ``carry`` (a long) if one is named.

    ``size`` is the text's UTF-8 bytes plus 1 (a null text has 1 and the checksum of an empty one).  ``map_path`` holds the
    map's versions; where nothing is, version 0 deals the slots out in turn; a map of more shards than asked for is an error.  Law ``bytes``: shards differ by less than the smallest slot
    that could still move.  ``slot`` numbers the rows of a shard from 0 without gaps, in order of virtual slot, part,
    id and checksum; rows equal in all of these are interchangeable.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"),
        *([F.col(carry).alias("carry")] if carry else []),
    )
    narrow, _ = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("times")), "sizes")  # the texts are read once
    placed, _ = materialize(virtual_slots(narrow, slots), "slots")
    counts = {(r["vslot"], r["part"]): (r["b"], r["n"]) for r in placed.groupBy("vslot", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}  # slots * PARTS
    weight = [0] * slots
    for (slot, _part), (size, _n) in counts.items():
        weight[slot] += size
    owners = edited_map(spark, map_path, weight, shards)
    start, offsets = [0] * shards, []
    for slot, part in sorted(counts):
        offsets.append((slot, part, owners[slot], start[owners[slot]]))
        start[owners[slot]] += counts[slot, part][1]
    where = F.broadcast(spark.createDataFrame(offsets, "vslot int, part int, shard int, offset long"))  # slots * PARTS rows
    within = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("rank", F.row_number().over(within)).join(where, ["vslot", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", *([F.col("carry").alias(carry)] if carry else []),
    )
