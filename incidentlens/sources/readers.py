"""Readers: text lines of each log format to normalized records, in built-in expressions throughout.

Input is a table of source_file, line_no, line (``records.read_lines`` or ``records.from_lines``); a document that
spans lines is read whole first.  Bad lines stay, with status ``error``, so that counting them needs no second pass.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from incidentlens.functions import times
from incidentlens.sources import records as R

# Keys that name the parts of a record, by format, most authoritative first.
JSON_TS = ("ts", "timestamp", "@timestamp", "time", "eventTime", "event_time")
JSON_SEVERITY = ("severity", "level", "log_level", "logLevel", "lvl", "loglevel")
JSON_SOURCE = ("source", "service", "service_name", "serviceName", "app", "logger", "host")
JSON_MESSAGE = ("message", "msg", "event", "text", "log")
OTLP_SERVICE = ("service.name", "service", "k8s.deployment.name", "host.name")
LOKI_SOURCE = ("service_name", "service", "app", "job", "container", "container_name", "pod", "host", "filename")
LOKI_SEVERITY = ("severity_text", "level", "severity", "detected_level")
ELASTIC_TS = ("@timestamp", "timestamp", "time", "event.created", "event.ingested")
ELASTIC_SEVERITY = ("log.level", "log.syslog.severity.name", "level", "severity", "log_level", "loglevel")
ELASTIC_MESSAGE = ("message", "event.original", "log.original", "msg")
ELASTIC_SOURCE = ("service.name", "container.name", "kubernetes.pod.name", "host.name", "host.hostname", "agent.name", "log.file.path")
RAW_SEVERITY = r"\b(TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|ERR|FATAL|CRITICAL|CRIT|SEVERE)\b"


#: Lines of a file that one task carries the last timestamp through.
RUN_LINES = 100_000


def _lines(df: DataFrame) -> DataFrame:
    return df.where(F.trim("line") != "")


def json_lines(df: DataFrame, year: int | None = None) -> DataFrame:
    """One object a line: the first key present names each part, the rest are fields."""
    rows = _lines(df).withColumn("obj", R.as_map(F.col("line")))
    obj = F.col("obj")
    used = lambda keys: F.coalesce(*[F.when(obj[F.lit(k)] != "null", F.lit(k)) for k in keys])
    roles = {"_ts": JSON_TS, "_severity": JSON_SEVERITY, "_source": JSON_SOURCE, "_message": JSON_MESSAGE}
    # Each part's key, then its value: projections of their own, so that neither is computed for every use of it.
    rows = rows.select("source_file", "line_no", "line", "obj", *[used(keys).alias(f"{role}_key") for role, keys in roles.items()])
    taken = F.array(*[F.coalesce(f"{role}_key", F.lit("")) for role in roles])
    rest = F.map_filter(obj, lambda k, v: ~F.array_contains(taken, k))
    rows = rows.select("source_file", "line_no", "line", obj.isNotNull().alias("_is"), R.to_fields(rest).alias("_fields"), *[obj[F.col(f"{role}_key")].alias(role) for role in roles])
    rows = rows.select("source_file", "line_no", "line", "_is", "_fields", *[R.plain(F.col(role)).alias(role) for role in roles])
    return R.record(
        rows, ts=R.parse_ts(F.col("_ts"), year), source=F.col("_source"), level=F.col("_severity"), raw=F.col("line"), message=F.coalesce("_message", "line"),
        fields=F.col("_fields"), fmt="json_lines", ok=F.col("_is"),
    )


def _list(v, *names: str):
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "array<variant>") for n in names])


def _text(v, *paths: str):
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])


def _scalar(v):
    """A wire value's scalar as text."""
    tags = [f"$.{n}Value" for n in ("string", "int", "bool", "double", "bytes")] + [f"$.{n}_value" for n in ("string", "int", "bool", "double", "bytes")]
    return _text(v, *tags)


_TAGS = {f"{name}{tail}": name for name in ("string", "int", "bool", "double", "bytes", "array", "kvlist") for tail in ("Value", "_value")}


def untagged(value):
    """A tagged wire value as plain data, however deep: whole numbers that came as text are numbers again, an empty value is null, what has no tag stays."""
    if not isinstance(value, dict):
        return value
    tag = next((t for t in _TAGS if t in value), None)
    if tag is None:
        return value or None
    inner, kind = value[tag], _TAGS[tag]
    if kind == "int":
        try:
            return int(inner)
        except (TypeError, ValueError):
            return inner
    if kind not in ("array", "kvlist"):
        return inner
    items = inner.get("values") if isinstance(inner, dict) else None
    items = items if isinstance(items, list) else []
    if kind == "array":
        return [untagged(i) for i in items]
    return {str(i["key"]): untagged(i.get("value")) for i in items if isinstance(i, dict) and i.get("key") is not None}


def _compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _in_arrow_batches(function):
    """A text-to-text function over Arrow batches; a null stays null, so rows that need no Python cost next to nothing."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else function(json.loads(t))), StringType())


_plain = _in_arrow_batches(lambda value: _compact(untagged(value)))


def _shown(value) -> str | None:
    """A plain value as a field's text: scalars as they are, containers as JSON."""
    return value if value is None or isinstance(value, str) else _compact(value)


_plain_pairs = _in_arrow_batches(lambda pairs: _compact({str(p["key"]): _shown(untagged(p.get("value"))) for p in pairs if isinstance(p, dict) and p.get("key") is not None}))


def _container(v):
    """Whether a wire value holds others."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "variant") for n in ("arrayValue", "kvlistValue", "array_value", "kvlist_value")]).isNotNull()


def _simple(v):
    return F.coalesce(_scalar(v), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def any_value(v):
    """A tagged wire value as text: scalars as they are, lists and key-value lists of any depth as plain JSON.

    Only values that hold others, whose depth no expression can follow, pass through Python.
    """
    return F.coalesce(_simple(v), _plain(F.when(_container(v), F.to_json(v))))


def _attributes(v, path: str):
    """A list of key-value pairs as a map of texts; the last of equal keys wins."""
    pairs = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    keyed = F.filter(F.transform(pairs, lambda p: F.struct(F.try_variant_get(p, "$.key", "string").alias("key"), _simple(F.try_variant_get(p, "$.value", "variant")).alias("value"))), lambda e: e["key"].isNotNull())
    flat = F.aggregate(keyed, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    deep = F.exists(pairs, lambda p: _container(F.try_variant_get(p, "$.value", "variant")))
    nested = F.from_json(_plain_pairs(F.when(deep, F.to_json(F.try_variant_get(v, path, "variant")))), "map<string,string>")
    return F.coalesce(nested, flat)


def severity_of_number(n):
    """1 to 24 in bands of four; null outside."""
    return F.when(n.between(1, 24), F.element_at(F.array(*[F.lit(x) for x in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")]), (F.floor((n - 1) / 4) + 1).cast("int")))


def _with(entries, name: str, value):
    """A map with one entry set."""
    return F.map_concat(F.map_filter(entries, lambda k, _: k != name), F.map_from_arrays(F.array(F.lit(name)), F.array(value)))


def otlp(df: DataFrame) -> DataFrame:
    """Export requests, one a line: resource, scope and record levels flattened, both spellings of every name."""
    from incidentlens.functions.severity import mapped

    rows = _lines(df).withColumn("doc", F.try_parse_json("line"))
    bad = rows.where(_list(F.col("doc"), "resourceLogs", "resource_logs").isNull())
    res = rows.select("source_file", "line_no", F.explode(_list(F.col("doc"), "resourceLogs", "resource_logs")).alias("res"))
    res = res.withColumn("resource", _attributes(F.col("res"), "$.resource.attributes"))
    scope = res.select("source_file", "line_no", "resource", F.explode(_list(F.col("res"), "scopeLogs", "scope_logs")).alias("scope"))
    recs = scope.select("source_file", "line_no", "resource", F.explode(_list(F.col("scope"), "logRecords", "log_records")).alias("rec"))
    body = any_value(F.coalesce(F.try_variant_get("rec", "$.body", "variant"), F.parse_json(F.lit("{}"))))
    recs = recs.withColumn("own", _attributes(F.col("rec"), "$.attributes")).withColumn("body", body)
    v, resource, own = F.col("rec"), F.col("resource"), F.col("own")
    when = F.coalesce(*[F.nullif(_text(v, p), F.lit("0")) for p in ("$.timeUnixNano", "$.time_unix_nano", "$.observedTimeUnixNano", "$.observed_time_unix_nano")])
    text = _text(v, "$.severityText", "$.severity_text")
    number = F.try_variant_get(v, "$.severityNumber", "int")
    level = F.when(mapped(text).isNotNull(), text).otherwise(F.coalesce(severity_of_number(F.coalesce(number, F.try_variant_get(v, "$.severity_number", "int"))), text))
    trace, span = F.nullif(_text(v, "$.traceId", "$.trace_id"), F.lit("")), F.nullif(_text(v, "$.spanId", "$.span_id"), F.lit(""))
    merged = F.map_concat(F.map_filter(resource, lambda k, _: ~F.array_contains(F.map_keys(own), k) & ~k.isin(*OTLP_SERVICE)), own)
    for name, value in (("trace_id", trace), ("span_id", span)):
        merged = F.when(value.isNull(), merged).otherwise(_with(merged, name, value))
    service = F.coalesce(*[resource[F.lit(k)] for k in OTLP_SERVICE])
    good = R.record(recs, ts=times.from_epoch(when), source=service, level=level, raw=F.to_json(v), message=F.coalesce("body", F.lit("")), fields=F.to_json(merged), fmt="otlp")
    return good.unionByName(_errors(bad, "otlp"))


def _errors(bad: DataFrame, fmt: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return R.record(bad, ts=F.lit(None).cast("timestamp"), source=none, level=none, raw=F.col("line"), message=F.col("line"), fields=F.lit("{}"), fmt=fmt)


def loki(df: DataFrame) -> DataFrame:
    """Query responses, push payloads and one-entry-a-line exports; labels hold for every entry of their stream."""
    rows = _lines(df).withColumn("doc", F.try_parse_json("line"))
    doc = F.col("doc")
    kind = _text(doc, "$.data.resultType")
    streams = F.coalesce(F.when(kind.isNull() | (kind == "streams"), F.try_variant_get(doc, "$.data.result", "array<variant>")), F.try_variant_get(doc, "$.streams", "array<variant>"))
    single = F.when(_text(doc, "$.line").isNotNull(), F.array(doc))
    rows = rows.withColumn("streams", streams).withColumn("single", single)
    bad = rows.where("streams is null and single is null")
    each = rows.where("streams is not null").select("source_file", "line_no", F.explode("streams").alias("s"))
    labels = lambda v, p: F.coalesce(F.try_variant_get(v, p, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    each = each.select("source_file", "line_no", labels(F.col("s"), "$.stream").alias("labels"), F.explode(F.try_variant_get("s", "$.values", "array<variant>")).alias("e"))
    each = each.select(
        "source_file", "line_no", "labels", _text(F.col("e"), "$[0]").alias("at"), _text(F.col("e"), "$[1]").alias("text"), labels(F.col("e"), "$[2]").alias("more"), F.to_json("e").alias("raw")
    )
    one = rows.where("streams is null and single is not null").select(
        "source_file", "line_no", labels(doc, "$.labels").alias("labels"), _text(doc, "$.timestamp").alias("at"), _text(doc, "$.line").alias("text"), labels(doc, "$.none").alias("more"), F.col("line").alias("raw")
    )
    rows = each.union(one)
    first = lambda names: F.coalesce(*[F.nullif(F.trim(F.col("labels")[F.lit(n)]), F.lit("")) for n in names])
    level = F.coalesce(*[F.nullif(F.when(F.lower(F.trim(F.col("labels")[F.lit(n)])) != "unknown", F.trim(F.col("labels")[F.lit(n)])), F.lit("")) for n in LOKI_SEVERITY])
    rest = F.map_filter("labels", lambda k, _: ~k.isin(*LOKI_SOURCE, *LOKI_SEVERITY) & ~F.array_contains(F.map_keys("more"), k))
    good = R.record(rows, ts=R.parse_ts(F.col("at")), source=first(LOKI_SOURCE), level=level, raw=F.col("text"), message=F.col("text"), fields=F.to_json(F.map_concat(rest, "more")), fmt="loki", ok=F.col("text").isNotNull())
    return good.unionByName(_errors(bad, "loki"))


def _at(v, path: str):
    """A leaf under its dotted key, else nested."""
    nested = F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path.split(".")), "variant")
    leaf = F.when(F.schema_of_variant(nested).startswith("OBJECT"), None).otherwise(F.try_variant_get(nested, "$", "string"))
    return F.coalesce(F.try_variant_get(v, f"$['{path}']", "string"), leaf) if "." in path else F.coalesce(leaf, F.lit(None).cast("string"))


def elastic(df: DataFrame) -> DataFrame:
    """Search responses, one-document-a-line dumps, bare documents; each part under its dotted or its nested name."""
    rows = _lines(df).withColumn("doc", F.try_parse_json("line"))
    doc = F.col("doc")
    rows = rows.withColumn("hits", F.coalesce(F.try_variant_get(doc, "$.hits.hits", "array<variant>"), F.when(F.schema_of_variant(doc).startswith("OBJECT"), F.array(doc))))
    bad = rows.where("hits is null")
    docs = rows.where("hits is not null").select("source_file", "line_no", F.explode("hits").alias("hit"))
    docs = docs.select("source_file", "line_no", "hit", F.coalesce(F.try_variant_get("hit", "$._source", "variant"), F.col("hit")).alias("src"))
    docs = _elastic_fields(docs)
    v = F.col("src")
    first = lambda paths: F.coalesce(*[F.nullif(F.trim(_at(v, p)), F.lit("")) for p in paths])
    message = first(ELASTIC_MESSAGE)
    good = R.record(
        docs, ts=R.parse_ts(first(ELASTIC_TS)), source=first(ELASTIC_SOURCE), level=first(ELASTIC_SEVERITY), raw=F.to_json(v), message=F.coalesce(message, F.to_json(v)),
        fields=F.col("fields"), fmt="elastic",
    )
    return good.unionByName(_errors(bad, "elastic"))


def _opened(v, prefix=None, depth: int = 3):
    """An object's leaves as (dotted key, JSON text); ``depth`` levels are opened, deeper objects stay JSON."""
    entries = F.map_entries(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))))

    def leaf(e):
        key = e["key"] if prefix is None else F.concat(prefix, F.lit("."), e["key"])
        own = F.array(F.struct(key.alias("key"), F.to_json(e["value"]).alias("value")))
        return F.when(F.schema_of_variant(e["value"]).startswith("OBJECT"), _opened(e["value"], key, depth - 1)).otherwise(own) if depth > 1 else own

    return F.flatten(F.transform(entries, leaf))


def leaves(value, prefix: str = "") -> dict:
    """Nested objects as dotted keys."""
    out = {}
    for key, item in value.items():
        path = f"{prefix}.{key}" if prefix else key
        out.update(leaves(item, path) if isinstance(item, dict) else {path: item})
    return out


_ELASTIC_PARTS = frozenset((*ELASTIC_TS, *ELASTIC_SEVERITY, *ELASTIC_MESSAGE, *ELASTIC_SOURCE))
_other_leaves = _in_arrow_batches(lambda value: _compact({k: x for k, x in leaves(value).items() if k not in _ELASTIC_PARTS}))


def _elastic_fields(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fields``: all leaves of ``src`` but the record's parts as one JSON object, however deep.

    A document nested deeper than three levels, which leaves an object among its values, passes through Python.
    """
    few = F.filter(_opened(F.col("src")), lambda e: ~e["key"].isin(*sorted(_ELASTIC_PARTS)))
    docs = docs.withColumn("few", R.object_of(few))
    return docs.withColumn("fields", F.coalesce(_other_leaves(F.when(F.contains("few", F.lit('":{')), F.to_json("src"))), "few"))


def adopt_shape(sample: list[str], share: float = 0.9, year: int | None = None, clf: bool = False) -> str | None:
    """The first shape that reads in at least ``share`` of the sampled lines."""
    import re

    from incidentlens.sources import bootstrap

    for name in ("iso8601", "epoch", "syslog", "clf"):
        found = [m[0] for line in sample if (m := re.search(times.SHAPES[name], line))]
        if sample and sum(bootstrap.readable(t, year, clf) for t in found) / len(sample) >= share:
            return name
    return None


def raw_lines(df: DataFrame, shape: str | None = None, year: int | None = None, clf: bool = False) -> DataFrame:
    """Any text: a record a line.  A line without a timestamp takes the last one before it in its file, else 1970 and as many seconds as its number.

    ``clf`` reads common log format too, which is recognised but left alone by default.
    """
    rows = _lines(df)
    own = R.parse_ts(F.nullif(F.regexp_extract("line", times.SHAPES[shape], 0), F.lit("")), year, clf) if shape else F.lit(None).cast("timestamp")
    rows = rows.withColumn("own", own).withColumn("run", F.floor(F.col("line_no") / RUN_LINES))
    # The last time of each run of lines, then of the runs before: no task has to read a whole file.
    ends = rows.groupBy("source_file", "run").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("line_no"))).alias("end"))
    earlier = Window.partitionBy("source_file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("source_file").alias("_file"), F.col("run").alias("_run"), F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    rows = rows.join(ends, F.col("source_file").eqNullSafe(F.col("_file")) & (F.col("run") == F.col("_run")))
    before = Window.partitionBy("source_file", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ts", F.coalesce(F.last("own", ignorenulls=True).over(before), "carried", F.timestamp_seconds("line_no")))
    level = F.nullif(F.regexp_extract("line", RAW_SEVERITY, 1), F.lit(""))
    return R.record(rows, ts=F.col("ts"), source=F.lit(None).cast("string"), level=level, raw=F.col("line"), message=F.col("line"), fields=F.lit("{}"), fmt="raw_lines")


READERS = {"json_lines": json_lines, "otlp": otlp, "loki": loki, "elastic": elastic, "raw_lines": raw_lines}


def reader(name: str):
    if name not in READERS:
        raise KeyError(f"no reader {name!r}; known: {', '.join(READERS)}")
    return READERS[name]


def union_files(parts: dict[object, DataFrame]) -> DataFrame:
    """Records of several groups of files: each keeps its own reader; a file's stem names the source where the data did not."""
    out = None
    for df in parts.values():
        stem = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"(?:\.(?:gz|bz2|xz))?$", "")
        stem = F.regexp_replace(F.regexp_replace(stem, r"\.(?:gz|bz2|xz)$", ""), r"\.[^.]*$", "")
        df = df.withColumn("source", F.coalesce("source", stem))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
