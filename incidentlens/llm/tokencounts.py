"""Exact length histogram of a corpus under a tokenizer, and suffix sums over it.

Documents are encoded once and counted by encoded length; the histogram is
written and read again, so that its two readers below don't encode twice.  It is as
long as there are distinct lengths; sums over its tail answer, for every context
limit, how many documents pass it, and how many tokens a cut at it would keep.
The tail sums run in two levels (runs of ``SPAN`` lengths, then the runs), so
that no task holds the whole histogram.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.llm.common import materialize

SPAN = 1024

_loaded: dict[tuple[str, str], object] = {}


def default_vocabulary() -> tuple[str, str]:
    """(path of the ranks, pattern) of a public byte-level vocabulary, if that package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoder(path: str, pattern: str):
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def encoded_lengths(docs: DataFrame, text_col: str = "text", *, path: str, pattern: str) -> DataFrame:
    """One row per batch and length: n_tokens, n_docs (combined before any shuffle).  Null or empty text: 0 tokens."""

    def run(batches):
        for batch in batches:
            encode = encoder(path, pattern).encode_ordinary
            lengths = np.fromiter((len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()), dtype=np.int64, count=batch.num_rows)
            value, times = np.unique(lengths, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(times)], names=["n_tokens", "n_docs"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens long, n_docs long")


def histogram(docs: DataFrame, text_col: str = "text", *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """n_tokens, n_docs: every length that occurs, as a written table.  An empty table gives no rows."""
    if path is None:
        path, pattern = default_vocabulary()
    counted = encoded_lengths(docs, text_col, path=path, pattern=pattern).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    return materialize(counted, "lengths")[0]


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """Of a histogram (n_tokens, n_docs), for every length L in it:

    docs_longer and tokens_longer (of documents over L), docs_upto, tokens_upto, truncated_total (tokens
    kept if each document is cut at L), share_upto (share of documents no longer than L: quantiles).
    """
    run = F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_docs").cast("long").alias("n_docs"), F.floor(F.col("n_tokens") / SPAN).alias("run")
    rows = lengths.select(*run).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    runs = rows.groupBy("run").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select(
        F.col("run").alias("r"), *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"], *[F.sum(c).over(everything).alias(f"{c}_all") for c in "dt"]
    )  # as many rows as the longest document has runs of SPAN tokens
    tail = Window.partitionBy("run").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("d_in", F.coalesce(F.sum("n_docs").over(tail), F.lit(0))).withColumn("t_in", F.coalesce(F.sum("tokens").over(tail), F.lit(0)))
    rows = rows.join(runs, F.col("run") == F.col("r"))
    rows = rows.withColumn("docs_longer", F.col("d_in") + F.col("d_after")).withColumn("tokens_longer", F.col("t_in") + F.col("t_after"))
    return rows.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer", (F.col("d_all") - F.col("docs_longer")).alias("docs_upto"),
        (F.col("t_all") - F.col("tokens_longer")).alias("tokens_upto"),
        (F.col("t_all") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        ((F.col("d_all") - F.col("docs_longer")) / F.col("d_all")).alias("share_upto"),
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row: the truncated total at any limit, also one that no document's length equals."""
    upto = F.when(F.col("n_tokens") <= limit, F.col("n_docs") * F.col("n_tokens")).otherwise(F.col("n_docs") * limit)
    return sums.agg(F.lit(limit).alias("n_limit"), F.coalesce(F.sum(upto), F.lit(0)).alias("truncated_total"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that a share ``q`` of the documents doesn't exceed (null if none)."""
    return sums.where(F.col("share_upto") >= q).agg(F.min("n_tokens").alias("n_tokens"))
