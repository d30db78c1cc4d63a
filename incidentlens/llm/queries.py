"""The corpus operators' queries: each over its whole table with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from incidentlens.llm import chat, decontaminate, htmltext, langid, media, merkle, minhash, mixing, periodic, quality, sharding, tokencounts, toxicity
from incidentlens.llm.common import scratch_root, table


def map_path(spark: SparkSession, sf_dir: str, user: str) -> str:
    """Where the shard map of one data set and user is: in the cluster's shared folder it outlives the application, and later runs edit what earlier ones stored."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/') if shared else scratch_root(spark)}/shard-maps/{user}-{zlib.crc32(sf_dir.encode())}"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.plan(table(spark, sf_dir, "documents")).taken()
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.suffix_sums(tokencounts.histogram(table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), map_path(spark, sf_dir, "op7"), shards=8)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_mix_sources, op2_html_text, op3_minhash_dedup, op4_token_counts, op5_language_id, op6_decontaminate, op7_shard_rows, op8_toxicity,
            op9_media_columns, op10_chat_format, op11_periodic_runs, op12_merkle_manifest, op13_quality_rules,
        )
    }


#: CRC-32 of a short ASCII string, bit by bit over its bytes.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR))::VARCHAR || ':' || CAST({0} AS VARCHAR), '-')"
_OTHERS = ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

#: Every source's and then the subroots' levels as lists, a leaf's siblings from the levels above it, and the fold level by level.
_OP12 = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, sha256(concat({_OTHERS}, {_FIELD.format("text")})) AS leaf,
        sha256(concat({_OTHERS}, {_FIELD.format("replace(text, chr(10), '')")})) AS other, coalesce({_CRC32.format("CAST(doc_id AS VARCHAR)")} % 2 = 0, false) AS cut
    FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
levels(grp, level, nodes) AS (
    SELECT source, 0, list(leaf ORDER BY pos) FROM placed GROUP BY source
    UNION ALL
    SELECT grp, level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT grp, max_by(nodes, level)[1] AS subroot, max(level) AS depth FROM levels GROUP BY grp),
sources AS (SELECT *, row_number() OVER (ORDER BY encode(grp) NULLS FIRST) - 1 AS place FROM subroots),
crown(level, nodes) AS (
    SELECT 0, list(subroot ORDER BY place) FROM sources
    UNION ALL
    SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM crown WHERE len(nodes) > 1),
steps AS (
    SELECT p.source, p.pos, l.level AS step, l.nodes[p.pos // pow(3, l.level)::BIGINT // 3 * 3 + 1:p.pos // pow(3, l.level)::BIGINT // 3 * 3 + 3] AS run, (p.pos // pow(3, l.level)::BIGINT % 3)::BIGINT AS slot
    FROM placed p JOIN levels l ON l.grp IS NOT DISTINCT FROM p.source AND len(l.nodes) > 1
    UNION ALL
    SELECT p.source, p.pos, s.depth + c.level, c.nodes[s.place // pow(3, c.level)::BIGINT // 3 * 3 + 1:s.place // pow(3, c.level)::BIGINT // 3 * 3 + 3], (s.place // pow(3, c.level)::BIGINT % 3)::BIGINT
    FROM placed p JOIN sources s ON s.grp IS NOT DISTINCT FROM p.source JOIN crown c ON len(c.nodes) > 1),
paths AS (
    SELECT source, pos, list(struct_pack(l := array_to_string(run[1:slot], ''), r := array_to_string(run[slot + 2:3], '')) ORDER BY step) AS path FROM steps GROUP BY source, pos),
proved AS (
    SELECT p.*, s.subroot, coalesce(t.path, []) AS path FROM placed p JOIN sources s ON s.grp IS NOT DISTINCT FROM p.source
    LEFT JOIN paths t ON t.source IS NOT DISTINCT FROM p.source AND t.pos = p.pos),
folded(source, pos, step, node) AS (
    SELECT source, pos, 1, CASE WHEN cut THEN other ELSE leaf END FROM proved
    UNION ALL
    SELECT f.source, f.pos, f.step + 1, sha256(p.path[f.step].l || f.node || p.path[f.step].r)
    FROM folded f JOIN proved p ON p.source IS NOT DISTINCT FROM f.source AND p.pos = f.pos WHERE f.step <= len(p.path)),
ends AS (SELECT source, pos, max_by(node, step) AS node FROM folded GROUP BY source, pos),
root AS (SELECT max_by(nodes, level)[1] AS root FROM crown)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256, e.node AS folded_root, e.node = root AS verified
FROM proved p JOIN ends e ON e.source IS NOT DISTINCT FROM p.source AND e.pos = p.pos, root
"""

_WORD, _BARE = r"[^\x20\x09-\x0D]+", r"regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')"

#: The base by windows of eight words as rows; the rules in the order in which they are declared.
_OP13 = rf"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
    SELECT *, regexp_extract_all(t, '{_WORD}') AS w, length({_BARE}) AS bare, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS symbols
    FROM texts),
starts AS (SELECT row, unnest(range(len(w) - 7)) AS i, w FROM split WHERE len(w) >= 8),
windows AS (SELECT row, i, count(*) OVER (PARTITION BY row, w[i + 1:i + 8]) AS n FROM starts),
repeated AS (SELECT row, count(DISTINCT i + k) AS n FROM windows, range(8) AS o(k) WHERE n > 1 GROUP BY row),
base AS (
    SELECT s.*, len(w) AS n_words, bare AS word_chars, symbols AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
    FROM split s LEFT JOIN repeated r ON s.row = r.row),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR bare > 25 * n_words OR 2 * symbols > bare OR 10 * length(regexp_replace(t, '\P{{L}}+', '', 'g')) < 3 * bare
        OR 100 * (length(t) - length(replace(replace(t, chr(65533), ''), chr(0), ''))) > length(t) OR (len(lines) >= 10 AND 2 * len(list_distinct(lines)) < len(lines))
        OR (len(lines) >= 10 AND 10 * len(list_filter(lines, lambda x: regexp_matches(rtrim(x, ' '), '(…|[.]{{3}})$'))) > 9 * len(lines))) AS kept
FROM judged
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it.  Keyed permutations, rolling hashes, learned models and automata it can't: tests/llm compares those with brute force."""
    return {"op12_merkle_manifest": _OP12, "op13_quality_rules": _OP13}
