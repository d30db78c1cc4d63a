"""Redaction: secrets and personal data become stable placeholders before anything else reads a line.

A value's token is ``[ENTITY:8 hex]`` of a keyed digest, so equal values keep one token.  Matches need
look-around and a digest for each, which no built-in expression gives, hence one Arrow function over
the text columns; counts come back beside the text.  The vault (token to value) is a separate
table that is never registered for queries.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Entities in the order they apply, those on by default, and their patterns.
ENTITIES = ("api_key", "email", "ipv6", "ipv4", "ssn", "phone")
DEFAULT_ENTITIES = ("api_key", "email", "ipv6", "ipv4", "ssn")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "api_key": re.compile(
        r"(?i)(?:\b[\w-]*?(?:api[_-]?key|access[_-]?token|auth[_-]?token|secret|bearer|token)[\"']?(?:\s*[:=]\s*|\s+)[\"']?(?P<value>[A-Za-z0-9_\-\.]{16,}))"
        r"|(?:\b[\w-]*?(?:password|passwd|passphrase|pwd|pw|secret)[\"']?\s*[:=]\s*[\"']?(?P<value_secret>(?!\*+(?!\S)|null\b|none\b|\[)[^\s\"',;&]{4,}))"
        r"|(?:\bbasic\s+(?P<value_basic>[A-Za-z0-9+/]{16,}={0,2}))"
    ),
    "email": re.compile(r"\b[\w.+-]+@[\w-]+\.[\w.-]*[A-Za-z]\b"),
    "ipv6": re.compile(
        rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,7}}:(?:{_HEX}(?::{_HEX}){{0,6}})?|::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:.])"
    ),
    "ipv4": re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d)(?!\.\d)"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "phone": re.compile(r"(?<![\d.\-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d.\-])"),
}
#: What stands before an address that is a version number.
GUARDS = {"ipv4": re.compile(r"(?i)\b(?:v|ver|version|release|build|rev|schema)\.?\s*$")}
HASH_CHARS = 8
#: What a Python worker holds at once, whatever the size of a table or of its texts: rows and bytes that it is sent together, and bytes of text that it redacts together.
BATCH_ROWS, BATCH_BYTES, PIECE_BYTES = 2_000, 8 << 20, 2 << 20
_KEY_WORDS = ("key", "token", "secret", "bearer", "pass", "pwd", "pw", "basic")
#: What a text must hold for a pattern to match at all: told by substring searches, which spare most lines the pattern.
NEEDS = {
    "api_key": lambda text: any(word in text.casefold() for word in _KEY_WORDS), "email": lambda text: "@" in text, "ipv6": lambda text: text.count(":") >= 2,
    "ipv4": lambda text: text.count(".") >= 3, "ssn": lambda text: text.count("-") >= 2, "phone": lambda text: True,
}


class Redactor:
    """Entities to look for and the salt of the tokens; ``digest`` is blake2s, or sha256 for checks against SQL."""

    def __init__(self, salt: str, entities: tuple[str, ...] = DEFAULT_ENTITIES, digest: str = "blake2s"):
        if unknown := set(entities) - set(ENTITIES):
            raise ValueError(f"unknown entities: {', '.join(sorted(unknown))}")
        if digest not in ("blake2s", "sha256"):
            raise ValueError(f"unknown digest: {digest}")
        self.salt, self.digest = salt, digest
        self.entities = tuple(e for e in ENTITIES if e in entities)

    def token(self, entity: str, value: str) -> str:
        data = f"{self.salt}:{entity}:{value}".encode()
        found = hashlib.sha256(data).hexdigest() if self.digest == "sha256" else hashlib.blake2s(data, digest_size=8).hexdigest()
        return f"[{entity.upper()}:{found[:HASH_CHARS]}]"

    def redact(self, text: str | None, found: list[tuple[str, str, str]] | None = None) -> str | None:
        """The text with placeholders; each replacement is added to ``found`` as (entity, token, value)."""
        if not text:
            return text
        for entity in self.entities:
            if not NEEDS[entity](text):
                continue
            guard, out, at = GUARDS.get(entity), [], 0
            for m in PATTERNS[entity].finditer(text):
                if guard is not None and guard.search(text[max(0, m.start() - 64) : m.start()]):
                    continue
                group = next((g for g in PATTERNS[entity].groupindex if m[g] is not None), 0)
                token = self.token(entity, m[group])
                if found is not None:
                    found.append((entity, token, m[group]))
                out += [text[at : m.start(group)], token]
                at = m.end(group)
            if out:
                text = "".join([*out, text[at:]])
        return text

    def redact_value(self, value, found=None):
        """Strings in nested lists and dicts; keys stay."""
        if isinstance(value, str):
            return self.redact(value, found)
        if isinstance(value, list):
            return [self.redact_value(v, found) for v in value]
        return {k: self.redact_value(v, found) for k, v in value.items()} if isinstance(value, dict) else value

    def redact_json(self, text: str | None, found=None) -> str | None:
        """A JSON text's strings; what isn't JSON is redacted as text."""
        if not text:
            return text
        try:
            return json.dumps(self.redact_value(json.loads(text), found), ensure_ascii=False)
        except ValueError:
            return self.redact(text, found)


def _bounded(spark: SparkSession) -> None:
    """Bounds the batches that Python workers are sent; a session's smaller bounds stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = str(spark.conf.get(key))
            if not now.isdigit() or not 0 < int(now) <= most:
                spark.conf.set(key, str(most))
        except Exception:  # an older Spark has only the row bound
            pass


def pieces(batch: pa.RecordBatch, names: list[str], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text takes ``most`` bytes or less; a row that is longer is alone."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for c in names:
        sizes += pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(c))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def redact_columns(df: DataFrame, redactor: Redactor, text: tuple[str, ...] = ("raw", "message"), fields: tuple[str, ...] = ("fields",)) -> DataFrame:
    """``df`` with its text and JSON columns redacted, and ``redactions``: entity, token and value of each replacement.

    Text columns with the same content are redacted, and counted, once.
    """
    every = list(df.columns)
    columns = [c for c in every if c not in (*text, *fields)]
    names = [c for c in (*text, *fields) if c in every]
    item = pa.struct([("entity", pa.string()), ("token", pa.string()), ("value", pa.string())])

    def run(batches):
        for batch in (piece for whole in batches for piece in pieces(whole, names)):
            source = {c: batch.column(batch.schema.names.index(c)).to_pylist() for c in names}
            out = {c: [] for c in names}
            log = []
            for i in range(batch.num_rows):
                found, done = [], {}
                for c in names:
                    value = source[c][i]
                    if c in fields:
                        out[c].append(redactor.redact_json(value, found))
                    else:
                        if value not in done:
                            done[value] = redactor.redact(value, found)
                        out[c].append(done[value])
                log.append([{"entity": e, "token": t, "value": v} for e, t, v in found])
            arrays = [batch.column(batch.schema.names.index(c)) if c in columns else pa.array(out[c], pa.string()) for c in every]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(log, pa.list_(item))], names=[*every, "redactions"])

    _bounded(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("redactions", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("entity", "token", "value")])))])
    return df.mapInArrow(run, schema)


def tallies(redacted: DataFrame) -> DataFrame:
    """entity, n: replacements made (placeholders that were already there aren't counted)."""
    return redacted.select(F.inline("redactions")).groupBy("entity").agg(F.count("*").alias("n"))


def vault(redacted: DataFrame, order: str = "id") -> DataFrame:
    """token, entity, value: to be written apart, with its own permissions.  Of values with one token the first, by row and place, is kept."""
    each = redacted.select(F.col(order).alias("row"), F.posexplode("redactions").alias("place", "r")).select("row", "place", "r.*")
    first = F.min_by(F.struct("entity", "value"), F.struct("row", "place", "entity", "value"))
    return each.groupBy("token").agg(first.alias("kept")).select("token", "kept.entity", "kept.value")


def reveal(vault_table: DataFrame, token: str | None = None, everything: bool = False) -> DataFrame:
    """One token's row, or all of them by entity and token; exactly one of the two must be asked for."""
    if (token is None) == (not everything):
        raise ValueError("ask for one token or for everything")
    return vault_table.orderBy("entity", "token") if everything else vault_table.where(F.col("token") == token)


def counts(found: list[tuple[str, str, str]]) -> dict[str, int]:
    return dict(Counter(e for e, _, _ in found))
