"""Many texts looked for at once: an automaton over all of them in one scan of the rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.operators.ranks import numbered
from incidentlens.operators.reads import _LOWER, _UPPER, ascii_lower

#: Markers that one automaton takes, by their number and bytes; more are looked for in further scans.
CHUNK, CHUNK_BYTES = 50_000, 16 << 20
_FOLD = str.maketrans(_UPPER, _LOWER)


def _chunks(placed: DataFrame) -> list[list[tuple[int, str]]]:
    """The numbered markers in groups that fit a task, fetched group by group."""
    part = F.floor((F.col("number") - 1) / CHUNK)
    sizes = sorted((r["p"], r["bytes"]) for r in placed.groupBy(part.alias("p")).agg(F.sum(F.octet_length("marker")).alias("bytes")).collect())  # a row per CHUNK markers
    for p, size in sizes:
        pieces = max(1, -(-size // CHUNK_BYTES))
        for piece in range(pieces):
            rows = placed.where((part == p) & (F.col("number") % pieces == piece)).collect()  # CHUNK markers and about CHUNK_BYTES at most
            if rows:
                yield [(r["number"], r["marker"]) for r in rows]


def holders(rows: DataFrame, markers: DataFrame, key: str, text: str = "message", fold: bool = True) -> DataFrame:
    """(marker, key): the distinct keys of the rows whose text holds each marker, A-Z folded unless ``fold`` is off.

    ``markers`` has a column ``marker``; repeated markers count once, a null one is found nowhere, an empty one in every text.
    """
    import ahocorasick

    same = ascii_lower if fold else lambda c: c
    distinct = markers.where("marker is not null").select(same(F.col("marker")).alias("marker")).distinct()
    placed, spark, found = numbered(distinct, ["marker"], "number"), rows.sparkSession, None
    kind = rows.schema[key].dataType.simpleString()
    for chunk in _chunks(placed):
        shared = spark.sparkContext.broadcast(chunk)

        def each(batches, shared=shared):
            automaton, always = ahocorasick.Automaton(), []
            for number, marker in shared.value:
                if marker:
                    automaton.add_word(marker, number)
                else:
                    always.append(number)
            automaton.make_automaton()
            for batch in batches:
                hits = set()
                for owner, body in zip(batch["key"], batch["text"], strict=True):
                    if body is not None:
                        hits.update((number, owner) for number in always)
                        if len(automaton):
                            hits.update((number, owner) for _, number in automaton.iter(body.translate(_FOLD) if fold else body))
                yield pd.DataFrame(sorted(hits), columns=["number", "key"])

        some = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(each, f"number long, key {kind}").distinct()
        found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], f"marker string, {key} {kind}")
    named = found.join(placed, "number").select(F.col("marker").alias("_low"), F.col("key").alias(key))
    return markers.select("marker").distinct().join(named, same(F.col("marker")) == F.col("_low")).select("marker", key)
