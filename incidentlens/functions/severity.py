"""Severity: one ordered scale of six levels, and the levels a message's own words suggest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The normalized levels in rank order and the spellings that map to them.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
ALIASES = {
    "TRACE": "TRACE", "VERBOSE": "TRACE", "FINEST": "TRACE",
    "DEBUG": "DEBUG", "FINE": "DEBUG",
    "INFO": "INFO", "INFORMATION": "INFO", "INFORMATIONAL": "INFO", "NOTICE": "INFO",
    "WARN": "WARN", "WARNING": "WARN",
    "ERROR": "ERROR", "ERR": "ERROR", "SEVERE": "ERROR",
    "FATAL": "FATAL", "CRIT": "FATAL", "CRITICAL": "FATAL", "ALERT": "FATAL", "EMERG": "FATAL", "EMERGENCY": "FATAL", "PANIC": "FATAL",
}
DEFAULT = "INFO"
# The weight of each level in the anomaly score.
WEIGHTS = {"TRACE": 0.00, "DEBUG": 0.05, "INFO": 0.15, "WARN": 0.50, "ERROR": 0.80, "FATAL": 1.00}
# Words that mark an unlabelled text as a failure or a warning.
FAILURE_WORDS = (
    "error|errors|failed|failure|failures|fail|fails|failing|fatal|panic|panicked|exception|traceback|assert|asserted|assertion|segfault|core dumped|aborted"
)
WARNING_WORDS = (
    "warn|warning|warnings|timeout|timed out|refused|denied|unable|cannot|could not|no such|not found|missing|invalid|undefined|unexpected|killed|non-zero|deprecated"
)
ANSI = "\\x1b\\[[0-9;]*[A-Za-z]"


def _lookup(key: Column, table: dict, other: Column | None = None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if other is None else out.otherwise(other)


def mapped(value: Column) -> Column:
    """The level a spelling names, null if it names none."""
    key = F.upper(F.trim(value.cast("string")))
    levels = {level: [a for a, to in ALIASES.items() if to == level] for level in LEVELS}
    out = None
    for level, names in levels.items():
        out = F.when(key.isin(names), F.lit(level)) if out is None else out.when(key.isin(names), F.lit(level))
    return out


def normalize(value: Column) -> Column:
    """The level, INFO for what isn't known (count those: ``mapped(value).isNull()``)."""
    return F.coalesce(mapped(value), F.lit(DEFAULT))


def rank(level: Column) -> Column:
    """0 to 5 in order of LEVELS; unknown levels rank lowest."""
    return _lookup(F.upper(level), {name: i for i, name in enumerate(LEVELS)}, F.lit(0))


def weight_of_rank(ranked: Column) -> Column:
    """The weight of a rank, clamped to the scale."""
    clamped = F.least(F.greatest(ranked, F.lit(0)), F.lit(len(LEVELS) - 1))
    return _lookup(clamped, {i: WEIGHTS[name] for i, name in enumerate(LEVELS)})


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def lexical(text: Column) -> Column:
    """The weight of ERROR, WARN or INFO, by whole words of the text in any case."""
    plain = strip_ansi(text)
    return (
        F.when(plain.rlike(rf"(?i)\b(?:{FAILURE_WORDS})\b"), F.lit(WEIGHTS["ERROR"]))
        .when(plain.rlike(rf"(?i)\b(?:{WARNING_WORDS})\b"), F.lit(WEIGHTS["WARN"]))
        .otherwise(F.lit(WEIGHTS["INFO"]))
    )
