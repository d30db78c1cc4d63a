"""Media payloads as content-defined chunks.

A payload (the text's UTF-8 bytes, padded with zero bytes to a positive multiple
of 64) is cut where a rolling gear hash of its last 32 bytes has ten zero bits, so
equal passages of different payloads give equal chunks.  Spark joins digests, not
payloads: they decide which payload stores a shared chunk.  The store is a Parquet
table in the shared folder: of each payload the object's beginning (format, ordered chunk list of lengths and digests) and the
samples (8 bit) of the chunks it stores.  The stored form is that beginning with all samples behind it.  Payloads are rebuilt from it:
most hold all their chunks and are rebuilt where they are read; only chunks that
another payload stores travel.  What is read back is held against the stored chunk list and
the digest of the text; a chunk that is missing or differs fails the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm import kernels as K
from incidentlens.llm.common import materialize, maybe_broadcast

PAD, CUT_BITS, LEAST, MOST, DIGEST = 64, 10, 256, 8192, 16
MAGIC = b"CDC1"

_GEAR = (K.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payload(text: str | None) -> tuple[bytes, int]:
    """(padded bytes, bytes before padding)."""
    data = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % PAD if data else PAD), len(data)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: the last is ``len(data)``.

    The gear hash h = 2h + gear[byte] over 32 bits forgets what is over 32 bytes back, so it is the
    sum of shifted gear values and takes five doubling steps over the whole buffer.
    """
    out, start = [], 0
    candidates = []
    for lo in range(0, len(data), K.PIECE):  # pieces overlap by the hash's reach
        begin = max(0, lo - 31)
        h = _GEAR[np.frombuffer(data, dtype=np.uint8, count=min(len(data), lo + K.PIECE) - begin, offset=begin)]
        for shift in (1, 2, 4, 8, 16):
            h[shift:] += h[:-shift].copy() << np.uint32(shift)
        ends = np.flatnonzero(h[lo - begin :] >> np.uint32(32 - CUT_BITS) == 0) + lo + 1
        candidates.append(ends)
    ends = np.concatenate(candidates) if candidates else np.zeros(0, dtype=np.int64)
    i = 0
    while start < len(data):
        i = int(np.searchsorted(ends, start + LEAST, side="left"))
        end = int(ends[i]) if i < len(ends) else len(data)
        end = min(end, start + MOST, len(data))
        out.append(end)
        start = end
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def head_of(parts: list[bytes]) -> bytes:
    """The stored object's beginning: the format's name and the ordered chunk list (length, digest)."""
    return b"".join([MAGIC, struct.pack("<I", len(parts)), *[struct.pack("<I", len(c)) + digest(c) for c in parts]])


def listed_in(head: bytes) -> list[tuple[int, bytes]]:
    """(length, digest) of every chunk that a stored beginning names."""
    n = struct.unpack_from("<I", head, len(MAGIC))[0] if head.startswith(MAGIC) and len(head) >= len(MAGIC) + 4 else -1
    if len(head) != len(MAGIC) + 4 + n * (4 + DIGEST):
        raise ValueError("not a stored media object")
    first, step = len(MAGIC) + 4, 4 + DIGEST
    return [(struct.unpack_from("<I", head, at)[0], head[at + 4 : at + step]) for at in range(first, first + n * step, step)]


def feature(data: bytes, parts: list[bytes]) -> str:
    """Chunks, distinct chunks, and mean, deviation and zero crossings (around 128) of the samples."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    mean, square = int(x.sum()) / len(x), int((x * x).sum()) / len(x)
    crossings = int((np.diff((x >= 128).astype(np.int8)) != 0).sum())
    return f"chunks={len(parts)};distinct={len(set(parts))};mean={mean:.4f};dev={max(0.0, square - mean * mean) ** 0.5:.4f};crossings={crossings}"


_CHUNK = "array<struct<digest:binary,n:int>>"
_STORED = "key binary, n_bytes long, n_chunks int, head binary, own array<struct<at:int,samples:binary>>"
_MEDIA = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (digest of the text), n_bytes, chunks: the ordered chunk list of every row."""

    def run(batches):
        for batch in batches:
            sizes, lists = [], []
            for text in batch.column(2).to_pylist():
                data, n = payload(text)
                sizes.append(n)
                lists.append([{"digest": digest(c), "n": len(c)} for c in chunks(data)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32())])))],
                names=["doc_id", "key", "n_bytes", "chunks"],
            )

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"doc_id long, key binary, n_bytes long, chunks {_CHUNK}")


def verified(key: bytes, n_bytes: int, head: bytes, own: list[dict]) -> list[bytes]:
    """The payload's chunks in order, each equal to its entry in the stored beginning; else an error."""
    held, listed = {c["at"]: c["samples"] for c in own}, listed_in(head)
    for i, (length, known) in enumerate(listed):
        if i not in held:
            raise ValueError(f"chunk {i} of payload {key.hex()} is missing")
        if len(held[i]) != length or digest(held[i]) != known:
            raise ValueError(f"chunk {i} of payload {key.hex()} differs from its digest")
    parts = [held[i] for i in range(len(listed))]
    if hashlib.sha256(b"".join(parts)[:n_bytes]).digest() != key:
        raise ValueError(f"payload {key.hex()} differs from its digest")
    return parts


class MediaStore:
    """Chunks of ``docs`` in the shared folder.

    ``recipes``: every row's chunk list; ``store``: per payload its chunk list and the samples it stores;
    ``borrowed``: (key, at, owner, owner_at) for each chunk that another place stores.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.recipes, self.recipes_path = materialize(recipes(docs, id_col, text_col), "recipes")
        # One row of each text carries its payload: the one with the smallest id.
        texts = self.recipes.groupBy("key").agg(F.min("doc_id").alias("carrier"), F.count("*").alias("n_rows"))
        carried = self.recipes.join(texts.where("n_rows > 1").select(F.col("key").alias("k"), "carrier"), F.col("key") == F.col("k"), "left")
        carried = carried.where("k is null or doc_id <=> carrier")
        listed = carried.select("key", F.posexplode("chunks").alias("at", "chunk")).select("key", "at", F.col("chunk.digest").alias("digest"))
        owners = listed.groupBy("digest").agg(F.min(F.struct("key", "at")).alias("owner"), F.count("*").alias("n_uses")).where("n_uses > 1")
        borrowed = listed.join(owners.select("digest", "owner"), "digest").where("key != owner.key or at != owner.at")
        self.borrowed, _ = materialize(
            borrowed.select("key", "at", F.col("owner.key").alias("owner"), F.col("owner.at").alias("owner_at")).distinct(), "borrowed", merge=True
        )
        skips = self.borrowed.groupBy("key").agg(F.collect_list("at").alias("skip"))  # as long as one payload's list
        marks = texts.where("n_rows > 1").join(skips, "key", "full_outer").select(F.col("key").alias("k"), "carrier", F.coalesce("n_rows", F.lit(1)).alias("n_rows"), "skip")
        marks, _ = materialize(marks, "marks", merge=True)
        keyed = _keyed(docs, id_col, text_col)
        writers = keyed.join(maybe_broadcast(marks, 96), F.col("key") == F.col("k"), "left").where("k is null or n_rows = 1 or doc_id <=> carrier")

        def write(batches):
            for batch in batches:
                own, heads, counts, sizes = [], [], [], []
                for text, skip in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    data, n = payload(text)
                    parts, left_out = chunks(data), set(skip or ())
                    sizes.append(n)
                    heads.append(head_of(parts))
                    counts.append(len(parts))
                    own.append([{"at": i, "samples": c} for i, c in enumerate(parts) if i not in left_out])
                samples = pa.list_(pa.struct([("at", pa.int32()), ("samples", pa.binary())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int32()), pa.array(heads, pa.binary()), pa.array(own, samples)],
                    names=["key", "n_bytes", "n_chunks", "head", "own"],
                )

        self.store, self.store_path = materialize(writers.select("key", "text", "skip").mapInArrow(write, _STORED), "media")

    def media(self) -> DataFrame:
        """Per payload, read back from the store and verified: key, sizes, digests and features.

        A missing chunk, one that differs from its digest in the stored list, or a payload that differs from its key is an error.
        """
        whole = self.store.where(F.size("own") == F.col("n_chunks")).select("key", "n_bytes", "head", "own")
        partial = self.store.where(F.size("own") < F.col("n_chunks")).select("key", "n_bytes", "head", "own")
        needed = self.borrowed.select(F.col("owner").alias("okey"), F.col("owner_at").alias("oat"), "key", "at")
        lenders = self.borrowed.select(F.col("owner").alias("okey")).distinct()
        lent = self.store.select(F.col("key").alias("okey"), "own").join(maybe_broadcast(lenders, 48), "okey")
        lent = lent.select("okey", F.inline("own")).select("okey", F.col("at").alias("oat"), "samples")
        come = needed.join(lent.dropDuplicates(["okey", "oat"]), ["okey", "oat"]).groupBy("key").agg(F.collect_list(F.struct("at", "samples")).alias("come"))
        filled = partial.join(come, "key", "left").select("key", "n_bytes", "head", F.when(F.col("come").isNull(), F.col("own")).otherwise(F.concat("own", "come")).alias("own"))

        def rebuild(batches):
            for batch in batches:
                rows = []
                for key, n, head, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    parts = verified(key, n, head, own)
                    data = b"".join(parts)
                    form = head + data  # the object's bytes as they were read
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-PAD:]), len(form), hashlib.sha256(form).hexdigest(), feature(data, parts)))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]],
                    names=["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

        return whole.union(filled).mapInArrow(rebuild, _MEDIA)

    def restore(self) -> DataFrame:
        """doc_id, n_bytes, payload: every row's payload rebuilt from the store (the round trip)."""
        own = self.store.dropDuplicates(["key"]).select("key", F.inline("own")).select("key", "at", "samples")
        lent = self.borrowed.join(own.select(F.col("key").alias("owner"), F.col("at").alias("owner_at"), "samples"), ["owner", "owner_at"]).select("key", "at", "samples")
        parts = own.union(lent).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "samples"))).alias("parts"))
        return self.recipes.select("doc_id", "key", "n_bytes").join(parts, "key").select("doc_id", "n_bytes", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.samples))").alias("payload"))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes and what ``MediaStore.media`` reads back for its payload.

    A null or empty text is a payload of 64 zero bytes.  Equal texts share one payload and so all
    values; repeated rows each get a row.  A null id is kept.  Empty table: no rows.
    """
    store = MediaStore(docs, id_col, text_col)
    media, _ = materialize(store.media().dropDuplicates(["key"]), "readback", merge=True)
    rows = store.recipes.select("doc_id", "key", "n_bytes").join(media, "key", "left")
    present = F.when(F.col("payload_sha256").isNull(), F.raise_error(F.lit("a payload is missing from the store"))).otherwise(F.col("payload_sha256"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", present.alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature")
