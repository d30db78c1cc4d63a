"""Text helpers: masks ahead of templating, trace ids, clipping and fencing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentlens.functions.times import SHAPES

HEADER_CHARS = 64
PLACEHOLDER = r"\[[A-Z0-9_]+:[0-9a-f]+\]"
TRANSPORT_TS = r"^\s*\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z\s*"
# Where a trace id is looked for, in order.
TRACE_KEYS = ("trace_id", "traceId", "traceID", "trace-id", "dd.trace_id")


def mask_header(text: Column, width: int = HEADER_CHARS) -> Column:
    """Timestamps in the first ``width`` characters become ``<TS>``; further on they are content."""
    head = F.substring(text, 1, width)
    for shape in ("iso8601", "syslog", "clf", "epoch"):
        head = F.regexp_replace(head, SHAPES[shape], "<TS>")
    return F.concat(head, text.substr(F.lit(width + 1), F.length(text)))


def mask_transport(text: Column) -> Column:
    """A leading instant as a log shipper adds it, and any redaction placeholder, each become one token."""
    return F.regexp_replace(F.regexp_replace(text, TRANSPORT_TS, "<TS> "), PLACEHOLDER, "<REDACTED>")


def trace_id(fields_json: Column) -> Column:
    """The first usable trace id among TRACE_KEYS: a text that isn't blank, trimmed, or a whole number."""
    found = []
    for key in TRACE_KEYS:
        value = F.get_json_object(fields_json, f"$['{key}']")
        found.append(F.when(F.lower(F.trim(value)).isin("", "true", "false") | value.rlike(r"^\s*[\[{]") | value.rlike(r"^-?\d+\.\d+$"), None).otherwise(F.trim(value)))
    return F.coalesce(*found)


def like_escape(text: str) -> str:
    for c in "\\%_":
        text = text.replace(c, "\\" + c)
    return text


def clip(text: Column, limit: int) -> Column:
    """White space runs become one space; what is over the limit is dropped and counted."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    over = (F.length(flat) - limit).cast("string")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("...(+"), over, F.lit(" more chars)"))).otherwise(flat)


_BLOCK = "log_data"


def neutralise(text: Column) -> Column:
    """Text that can neither open nor close a data block: a bracket before the tag, however written, becomes a look-alike."""
    return F.regexp_replace(text, rf"(?i)(?:<|&lt;|&#0*60;|&#x0*3c;|\uFF1C)(\s*/?\s*){_BLOCK}", f"\u2039$1{_BLOCK}")


def fence(text: Column, kind: str) -> Column:
    """Log text as a data block; ``kind`` is the program's, never the log's."""
    return F.concat(F.lit(f'<{_BLOCK} kind="{kind}">\n'), neutralise(text), F.lit(f"\n</{_BLOCK}>"))


def tokens(text: Column) -> Column:
    """Runs between white space; none of a blank text."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))
