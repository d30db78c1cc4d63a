"""The normalized record that every reader yields, and helpers that build it from text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentlens.functions import severity as S
from incidentlens.functions import times

SCHEMA = (
    "ts timestamp, source string, severity string, raw string, message string, fields string, format string, source_file string, line_no long, "
    "severity_mapped boolean, status string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source_file, line_no, line: every line of text files with its place, in file order.

    A file is split over tasks; its line numbers are the running counts of its splits, so no file has
    to fit into a task.
    """
    rows = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    return number_lines(rows)


def number_lines(rows: DataFrame) -> DataFrame:
    """A split's lines lie behind one another in one task, so a line's place in it is how far its ``at`` is from the split's least: no line is moved."""
    per = rows.groupBy("source_file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("source_file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("base"))
    return rows.join(F.broadcast(base), ["source_file", "block"]).select("source_file", (F.col("base") + F.col("at")).alias("line_no"), "line")  # a row per split


def from_lines(df: DataFrame, text: str = "line", order: str = "line_no", name: str | None = None) -> DataFrame:
    """Lines that are already a table (name: a column with the file name)."""
    return df.select((F.col(name) if name else F.lit(None).cast("string")).alias("source_file"), F.col(order).cast("long").alias("line_no"), F.col(text).alias("line"))


def record(df: DataFrame, *, ts: Column, source: Column, level: Column, raw: Column, message: Column, fields: Column, fmt: str, ok: Column | None = None) -> DataFrame:
    """The record columns; status is ok, or error where ``ok`` or the timestamp fails.

    What is used more than once is computed in a projection of its own, hence once a row.
    """
    good = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    own = df.select(
        ts.alias("ts"), source.cast("string").alias("source"), level.cast("string").alias("_level"), raw.alias("raw"), message.alias("message"), fields.alias("fields"),
        F.col("source_file"), F.col("line_no"), good.alias("_good"),
    )
    own = own.withColumn("source", F.nullif(F.trim("source"), F.lit(""))).withColumn("_mapped", S.mapped(F.col("_level")))
    return own.select(
        "ts", "source", F.coalesce("_mapped", F.lit(S.DEFAULT)).alias("severity"), "raw", "message", "fields", F.lit(fmt).alias("format"), "source_file", "line_no",
        F.col("_mapped").isNotNull().alias("severity_mapped"), F.when(F.col("_good") & F.col("ts").isNotNull(), "ok").otherwise("error").alias("status"),
    )


def counted() -> list:
    """Aggregates over records: lines read, records, errors, and records whose severity is unknown."""
    ok = F.col("status") == "ok"
    return [F.count("*").alias("lines_read"), F.count_if(ok).alias("records"), F.count_if(~ok).alias("parse_errors"), F.count_if(ok & ~F.col("severity_mapped")).alias("unmapped_severity")]


def counters(records: DataFrame) -> DataFrame:
    """One row of ``counted``."""
    return records.agg(*counted())


def first_key(obj: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys of a map of JSON texts that is there and not null."""
    return F.coalesce(*[plain(obj[F.lit(k)]) for k in keys])


def plain(text: Column) -> Column:
    """A JSON value as text: strings lose their quotes; null is null.  Only a string with an escape has to be parsed."""
    bare = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(text == "null", None).when(text.startswith('"') & ~text.contains("\\"), bare).when(text.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]).otherwise(text)


def as_map(line: Column) -> Column:
    """A JSON object as a map of its keys to JSON texts; null for what isn't an object."""
    return F.when(F.trim(line).startswith("{"), F.transform_values(F.try_variant_get(F.try_parse_json(line), "$", "map<string,variant>"), lambda _, v: F.to_json(v)))


def object_of(entries: Column) -> Column:
    """Entries (key, JSON text) as one JSON object with its keys in order."""
    quoted = lambda k: F.regexp_replace(F.substring(F.to_json(F.struct(k.alias("k"))), 6, 1 << 30), r"\}$", "")
    pieces = F.transform(F.array_sort(entries), lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pieces, ","), F.lit("}"))


def to_fields(rest: Column) -> Column:
    """A map of JSON texts as one JSON object."""
    return object_of(F.map_entries(rest))


def parse_ts(text: Column, year: int | None = None, clf: bool = False) -> Column:
    return times.parse(text, year, clf)
