"""A Merkle manifest of a data set, kept as parents' preimages.

Rows are leaves; per source, in order of id, runs of three hash into their parent until one node, the subroot, remains, and
the subroots hash likewise into the root.  What is stored of a parent is its *preimage*: its children's hashes, 64 characters
each, one behind the other.  A leaf's proof needs nothing else: joined to its ancestors' preimages, it cuts
its own slot out of each for the siblings, and puts another hash into that slot to fold a changed row up to a root.

Preimages are stored in blocks of three levels (27 nodes, 13 parents), keyed by source and place, so a source of any
size is spread over its blocks.  Each round of three levels is one shuffle of a table 27 times smaller than
the last.  Going down again, blocks take their ancestors' preimages along, so leaves are joined once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.llm.common import materialize, maybe_broadcast

ARITY, LEVELS, HEX = 3, 3, 64
BLOCK = ARITY**LEVELS
_STEP = "struct<preimage:string,at:int>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of the fields, each with its length in bytes, so that no two rows are written alike."""
    return F.sha2(F.concat(*[_field(f) for f in fields]).cast("binary"), 256)


def hashed_rows(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, grp, leaf, other: each row's leaf, and the leaf of the row as tampered with (null where it isn't).

    ``grp`` is the source in a form that sorts null first and is never null.
    """
    key, text = F.col(fields[0]), F.col(fields[-1])
    grp = F.coalesce(F.concat(F.lit("="), F.col(fields[1]).cast("string")), F.lit("-"))
    cut = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(2)) == 0
    columns = [F.col(f) for f in fields]
    return docs.select(
        key.cast("long").alias("doc_id"), grp.alias("grp"), leaf_hash(columns).alias("leaf"),
        F.when(cut, leaf_hash([*columns[:-1], F.replace(text, F.lit("\n"), F.lit(""))])).alias("other"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with grp) plus ``pos`` (from 0 in its group) and ``n`` (the group's rows).

    Rows are dealt by ranges of group, order and a last tie-break, so neither a large group nor equal rows are one
    task's work; places come from counts per range and group.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = spread.repartitionByRange(parts, "grp", *order, "_tie").sortWithinPartitions("grp", *order, "_tie").drop("_tie")
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    held, _ = materialize(ranged, "ordered")
    counts = held.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("grp").orderBy("_part")  # a row per range
    counts = counts.withColumn("_before", F.sum("_rows").over(before) - F.col("_rows")).withColumn("n", F.sum("_rows").over(Window.partitionBy("grp")))
    counts = counts.select("grp", "_part", (F.col("_before") - F.col("_first")).alias("_shift"), "n")
    return held.join(maybe_broadcast(counts, 128), ["grp", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _preimages(hashes: str) -> str:
    return f"transform(sequence(0, (size({hashes}) - 1) div {ARITY}), i -> array_join(slice({hashes}, i * {ARITY} + 1, {ARITY}), ''))"


def round_up(nodes: DataFrame) -> DataFrame:
    """Three levels at once: (grp, block, n, p1, p2, p3, top) of nodes (grp, pos, n, hash).

    p1 to p3 are the preimages of the block's parents by level, null above the group's last level; ``top`` is the
    block's node after them.
    """
    found = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("kids"),  # BLOCK rows at most
    )
    found = found.select("grp", "block", "n", F.col("kids.hash").alias("h0"))
    for level in range(LEVELS):
        made = F.expr(_preimages(f"h{level}"))
        found = found.withColumn(f"p{level + 1}", F.when(F.col("n") > ARITY**level, made))
        found = found.withColumn(f"h{level + 1}", F.when(F.col(f"p{level + 1}").isNull(), F.col(f"h{level}")).otherwise(F.transform(f"p{level + 1}", lambda p: F.sha2(p.cast("binary"), 256))))
    return found.select("grp", "block", "n", *[f"p{level + 1}" for level in range(LEVELS)], F.element_at(f"h{LEVELS}", 1).alias("top"))


def _path(pos: str) -> Column:
    """The preimages above node ``pos`` in its joined block, lowest first, each with the node's slot in it."""
    steps = []
    for level in range(1, LEVELS + 1):
        within = f"({pos} % {BLOCK}) div {ARITY ** (level - 1)}"
        steps.append(f"if(p{level} is null, null, named_struct('preimage', element_at(p{level}, cast({within} div {ARITY} as int) + 1), 'at', cast({within} % {ARITY} as int)))")
    return F.expr(f"filter(array({', '.join(steps)}), s -> s is not null)")


@dataclass
class Forest:
    """``rounds``: stored preimages from the leaves up; ``tops``: (grp, hash) of every group's last node."""

    rounds: list[DataFrame]
    tops: DataFrame


def grow(nodes: DataFrame, label: str) -> Forest:
    """Preimages of every group of ``nodes`` (grp, pos, n, hash) up to its last node; as many rounds as the largest group needs."""
    rounds, tops = [], None
    while True:
        blocks, _ = materialize(round_up(nodes), f"{label}-{len(rounds)}", merge=True)
        rounds.append(blocks)
        done = blocks.where(F.col("n") <= BLOCK).select("grp", F.col("top").alias("hash"))
        tops = done if tops is None else tops.union(done)
        above = blocks.where(F.col("n") > BLOCK)
        if above.isEmpty():
            return Forest(rounds, tops)
        nodes = above.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("hash"))


def with_paths(forest: Forest, crowns: DataFrame) -> DataFrame:
    """The lowest blocks with ``upper``, the steps from the block's node to the root.

    ``crowns`` (grp, upper, and what else is carried) holds the steps above each group's last node.
    """
    carried = [c for c in crowns.columns if c not in ("grp", "upper")]
    above = None
    for blocks in reversed(forest.rounds):
        last = blocks.where(F.col("n") <= BLOCK).join(crowns, "grp").select(*blocks.columns, "upper", *carried)
        if above is None:
            above = last
            continue
        parents = above.select("grp", F.col("block").alias("_parent"), *[f"p{i + 1}" for i in range(LEVELS)], "upper", *carried)
        inner = blocks.where(F.col("n") > BLOCK).withColumn("_parent", F.floor(F.col("block") / BLOCK))
        own = inner.select("grp", "_parent", "block", "n", "top", *[F.col(f"p{i + 1}").alias(f"own{i + 1}") for i in range(LEVELS)])
        joined = own.join(parents, ["grp", "_parent"]).withColumn("upper", F.concat(_path("block"), "upper"))
        above = joined.select("grp", "block", "n", *[F.col(f"own{i + 1}").alias(f"p{i + 1}") for i in range(LEVELS)], "top", "upper", *carried).union(last)
    return above


def siblings(step: Column) -> Column:
    """A preimage without the node's own slot."""
    at, preimage = step["at"], step["preimage"]
    return F.concat(F.substr(preimage, F.lit(1), at * HEX), F.substr(preimage, (at + 1) * HEX + 1))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to: each preimage with the node so far spliced into its slot, hashed."""

    def up(node: Column, step: Column) -> Column:
        at, preimage = step["at"], step["preimage"]
        return F.sha2(F.concat(F.substr(preimage, F.lit(1), at * HEX), node, F.substr(preimage, (at + 1) * HEX + 1)).cast("binary"), 256)

    return F.aggregate(path, leaf, up)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``fields`` names the id, the source, other columns and the text, in the order in which they are hashed.  Rows of one source with one id are ordered by leaf
    (a null id comes first); fully equal rows are leaves of their own.  ``folded_root`` starts from the row as
    tampered with (no line feeds) where the id's checksum is even; a null id is never tampered with.  A single row is its own root and
    its proof hashes nothing.  Columns that aren't named are ignored.  Empty table: no rows.
    """
    spark = docs.sparkSession
    hashed, _ = materialize(hashed_rows(docs, fields), "leaves")  # the texts are read once
    leaves, _ = materialize(numbered(hashed, ["doc_id", "leaf"]), "numbered")
    forest = grow(leaves.select("grp", "pos", "n", F.col("leaf").alias("hash")), "preimages")
    sources = forest.tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash")
    ordered, _ = materialize(numbered(sources, ["name"]), "subroots")
    crown = grow(ordered.select("grp", "pos", "n", "hash"), "crown")
    top = crown.tops.first()  # one row
    if top is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    no_steps = spark.createDataFrame([("", [])], f"grp string, upper array<{_STEP}>")
    above = with_paths(crown, no_steps).withColumnRenamed("grp", "_all")
    named = ordered.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(above.drop("n"), "block")
    crowns, _ = materialize(named.select(F.col("name").alias("grp"), F.concat(_path("pos"), "upper").alias("upper"), F.col("hash").alias("subroot")), "crowns")
    paths, _ = materialize(with_paths(forest, crowns).drop("n", "top"), "paths", merge=True)
    placed = leaves.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(paths, ["grp", "block"])
    proved = placed.select("doc_id", "leaf", "other", "subroot", F.concat(_path("pos"), "upper").alias("path"))
    proof = F.sha2(F.array_join(F.transform("path", siblings), "").cast("binary"), 256)
    shown = proved.select("doc_id", "leaf", "subroot", F.lit(top["hash"]).alias("root"), proof.alias("proof_sha256"), fold(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
