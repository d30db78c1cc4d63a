"""Ground truth of labelled cases: which of its signals can be looked for in the case's log, and why the others can't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.functions.severity import strip_ansi
from incidentlens.operators import search

# Kinds of signal that are no text of a log, and the length under which a text tells no line.
NOT_TEXT, LEAST_CHARS = ("exit_code",), 12
_SIGNALS = "struct<required_signals:array<struct<type:string,importance:string,value:string,file:string>>>"


def markers(truth: DataFrame, lines: DataFrame, case: str = "case_id") -> DataFrame:
    """case, place, kind, marker, verdict: the critical signals of every case (truth: case, document; lines: case, line).

    A signal's text is its value, else its file.  ``verdict``: kept; not text; short; absent, where no line of the case's log holds it once terminal
    codes are taken from both.  A damaged document has no signals, a text that spans lines is absent.  All texts are looked for in one scan.
    """
    parsed = F.from_json("document", _SIGNALS)["required_signals"]
    each = truth.select(case, F.posexplode(parsed).alias("place", "s")).where("s.importance = 'critical'")
    text = F.trim(F.coalesce(F.nullif(F.col("s.value"), F.lit("")), F.col("s.file"), F.lit("")))
    each = each.select(case, "place", F.coalesce("s.type", F.lit("signal")).alias("kind"), text.alias("marker"))
    known = F.when(F.col("kind").isin(*NOT_TEXT), "not text").when(F.length("marker") < LEAST_CHARS, "short")
    each = each.withColumn("known", known).withColumn("plain", strip_ansi(F.col("marker")))
    asked = each.where("known is null").select(F.col("plain").alias("marker"))
    found = search.holders(lines.select(case, strip_ansi(F.col("line")).alias("line")), asked, case, "line", fold=False)
    found = found.select(F.col("marker").alias("plain"), case, F.lit(True).alias("held"))
    verdict = F.coalesce("known", F.when(F.col("held"), "kept"), F.lit("absent"))
    return each.join(found, ["plain", case], "left").select(case, "place", "kind", "marker", verdict.alias("verdict"))
