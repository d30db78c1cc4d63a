"""Timestamps: parsing, fixed-width rendering and the minute buckets that rates are counted in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
# The timestamp shapes that are recognised, most specific first.
SHAPES = {
    "iso8601": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?",
    "syslog": r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    "clf": r"\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}(?:\s[+-]\d{4})?",
    "epoch": r"\d{10}(?:\d{3}|\d{6}|\d{9})?",
}


#: Written-out forms (common log format first), each as (what it looks like once a weekday and the zone are taken off, Spark's pattern, Python's).
FREE = (
    (r"\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}", "dd/MMM/yyyy:HH:mm:ss", "%d/%b/%Y:%H:%M:%S"),
    (r"\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}", "d MMM yyyy HH:mm:ss", "%d %b %Y %H:%M:%S"),
    (r"[A-Z][a-z]{2} \d{1,2} \d{4} \d{2}:\d{2}:\d{2}", "MMM d yyyy HH:mm:ss", "%b %d %Y %H:%M:%S"),
    (r"[A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2} \d{4}", "MMM d HH:mm:ss yyyy", "%b %d %H:%M:%S %Y"),
    (r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}", "yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S"),
    (r"\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}", "MM/dd/yyyy HH:mm:ss", "%m/%d/%Y %H:%M:%S"),
    (r"\d{8}T\d{6}", "yyyyMMdd'T'HHmmss", "%Y%m%dT%H%M%S"),
)
WEEKDAY, ZONE = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? ", r"\s?(Z|GMT|UTC|[+-]\d{2}:?\d{2})$"


def parse_free(text: Column, clf: bool = False) -> Column:
    """The instant of a written-out form: day and month by name, slashes (month first), or without separators; no zone means UTC.

    Common log format is read only if asked for.
    """

    def taken_apart(text: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), WEEKDAY, ""), ",", "")
        zone = F.replace(F.regexp_extract(t, ZONE, 1), F.lit(":"), F.lit(""))
        return F.struct(F.regexp_replace(t, ZONE, "").alias("bare"), F.when(zone.isin("", "Z", "GMT", "UTC"), F.lit("+0000")).otherwise(zone).alias("zone"))

    def read(x: Column) -> Column:
        return F.coalesce(*[F.when(x["bare"].rlike(f"^(?:{shape})$"), F.try_to_timestamp(F.concat_ws(" ", x["bare"], x["zone"]), F.lit(f"{pattern} Z"))) for shape, pattern, _ in FREE[0 if clf else 1 :]])

    # Lambdas bind what is used often, and keep so large an expression out of the generated code, which other rows run.
    return F.transform(F.transform(F.array(text), taken_apart), read)[0]


def epoch_micros(value: Column) -> Column:
    """Microseconds from epoch seconds, milli-, micro- or nanoseconds, told apart by magnitude."""
    x, size, whole = value.cast("double"), F.abs(value.cast("double")), value.cast("decimal(38,9)")
    unit = F.when(size >= 1e17, F.lit(-3)).when(size >= 1e14, F.lit(0)).when(size >= 1e11, F.lit(3)).otherwise(F.lit(6))
    scaled = (
        F.when(unit == -3, whole / 1000).when(unit == 0, whole).when(unit == 3, whole * 1000).otherwise(whole * 1000000)
    )
    return F.when(x.isNotNull(), F.floor(scaled).cast("long"))


def from_epoch(value: Column) -> Column:
    return F.timestamp_micros(epoch_micros(value))


def parse(text: Column, year: int | None = None, clf: bool = False) -> Column:
    """The instant that a text names, null if none can be read.

    Numbers are epochs.  ISO forms may use a comma before the fraction, up to nine digits of it
    (cut to microseconds), a space for the T, and offsets with or without colon; no zone means UTC.
    A syslog form has no year: ``year`` supplies it, and without one it isn't read.  Other forms are those of ``parse_free``.
    """
    t = F.trim(text)
    digits = F.regexp_replace(F.regexp_replace(t, ",", "."), r"(\.\d{6})\d+", "$1")
    spaced = F.regexp_replace(F.regexp_replace(digits, r"^(\d{4}-\d{2}-\d{2})[ ](\d{2}:)", "$1T$2"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(t.rlike(rf"^(?:{SHAPES['iso8601']})$") | t.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2})?$"), F.try_to_timestamp(spaced))
    out = F.when(t.rlike(r"^-?\d+$"), from_epoch(F.when(t.rlike(r"^-?\d+$"), t))).otherwise(F.coalesce(iso, parse_free(t, clf)))
    if year is not None:
        dated = F.concat(F.lit(f"{year} "), F.regexp_replace(t, r"\s+", " "))
        out = F.coalesce(out, F.when(t.rlike(rf"^(?:{SHAPES['syslog']})$"), F.try_to_timestamp(dated, F.lit("yyyy MMM d HH:mm:ss"))))
    return out


def iso(ts: Column) -> Column:
    """27 characters, so that text order is time order."""
    return F.date_format(ts, ISO)


def bucket(ts: Column, minutes: int = 1) -> Column:
    """The minute; for wider buckets the hour and the minute of the hour divided by the width.

    The division restarts every hour, so a width that doesn't divide 60 leaves a short last bucket and 60 or
    more is the hour.
    """
    if minutes <= 1:
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:"), F.floor(F.minute(ts) / minutes).cast("string"))


def epoch_minute(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 60_000_000).cast("long")


def minutes_between(first: Column, last: Column) -> Column:
    return (F.unix_micros(last) - F.unix_micros(first)) / F.lit(6e7)
