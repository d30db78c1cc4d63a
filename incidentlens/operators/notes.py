"""Notes: what they cite, how they rank, what they leave out, and the free checks on them.

Notes are (note_id, step, note, template_ids, log_event_ids, confidence, role, synthesis).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.operators import reads, search
from incidentlens.operators.ranks import numbered, written

# The order of roles and confidences, and the share of events under which evidence is thin.
ROLE_RANK = {"accounting": 0, "finding": 1}
CONFIDENCE_RANK = {"low": 0, "medium": 1, "high": 2}
THIN_SHARE = 0.0005
NOTE_SCHEMA = (
    "note_id long, step long, note string, template_ids array<long>, log_event_ids array<long>, confidence string, role string, synthesis boolean"
)


class NoteError(ValueError):
    """A note that may not be written."""


def validate_note(note: dict, seen_events: set[int] | None = None) -> None:
    """Notes need text, evidence and a known confidence; cited events must have been shown."""
    if not str(note.get("note") or "").strip():
        raise NoteError("a note needs text")
    if not note.get("template_ids") and not note.get("log_event_ids"):
        raise NoteError("a note needs evidence")
    if note.get("confidence") not in CONFIDENCE_RANK:
        raise NoteError(f"confidence must be one of {', '.join(CONFIDENCE_RANK)}")
    if seen_events is not None and (unseen := set(note.get("log_event_ids") or ()) - seen_events):
        raise NoteError(f"events that were never shown: {sorted(unseen)}")


def citations(notes: DataFrame) -> DataFrame:
    """note_id, kind, id: every citation once."""
    one = lambda kind, column: notes.select("note_id", F.lit(kind).alias("kind"), F.explode(column).alias("id"))
    return one("template", "template_ids").union(one("event", "log_event_ids")).distinct()


def broken_citations(notes: DataFrame, events: DataFrame, templates: DataFrame) -> DataFrame:
    """note_id, kind, id: citations that nothing answers to."""
    cited = citations(notes)
    there = templates.select(F.lit("template").alias("kind"), F.col("template_id").alias("id")).union(events.select(F.lit("event").alias("kind"), "id"))
    return cited.join(there, ["kind", "id"], "left_anti").select("note_id", "kind", "id")


def _rank_of(column: str, table: dict[str, int], other: int):
    out = F.lit(other)
    for name, value in table.items():
        out = F.when(F.lower(F.col(column)) == name, F.lit(value)).otherwise(out)
    return out


def evidence_stats(notes: DataFrame, scores: DataFrame, templates: DataFrame) -> DataFrame:
    """Per note: best score, events covered, score-weighted events and the damped peak of what it cites."""
    cited = notes.select("note_id", F.explode("template_ids").alias("template_id")).distinct()
    facts = templates.select("template_id", "occurrence_count").join(scores.select("template_id", "score"), "template_id", "left").fillna(0.0, ["score"])
    got = cited.join(facts, "template_id").groupBy("note_id").agg(
        F.max("score").alias("top_score"), F.sum("occurrence_count").alias("mass"), F.sum(F.col("score") * F.col("occurrence_count")).alias("score_x_mass"),
        F.max(F.col("score") * F.log1p("occurrence_count")).alias("peak_scaled"),
    )
    zero = {"top_score": 0.0, "mass": 0, "score_x_mass": 0.0, "peak_scaled": 0.0}
    return notes.join(got, "note_id", "left").fillna(zero)


def rank_notes(notes: DataFrame, scores: DataFrame, templates: DataFrame) -> DataFrame:
    """Notes with ``rank``: by role, synthesis, best cited score, confidence, earlier step, then id."""
    stats = evidence_stats(notes, scores, templates)
    order = Window.orderBy(
        F.desc(_rank_of("role", ROLE_RANK, 1)), F.desc("synthesis"), F.desc("top_score"), F.desc(_rank_of("confidence", CONFIDENCE_RANK, 0)), "step", "note_id"
    )  # as many rows as notes were written
    return stats.withColumn("rank", F.row_number().over(order))


def alternative_ranks(notes: DataFrame, scores: DataFrame, templates: DataFrame) -> DataFrame:
    """ordering, note_id, rank under the orderings that the shipped one is compared with."""
    stats = evidence_stats(notes, scores, templates)
    out = rank_notes(notes, scores, templates).select(F.lit("current").alias("ordering"), "note_id", "rank")
    for name in ("mass", "score_x_mass", "peak_scaled"):
        order = Window.orderBy(F.desc(name), F.desc(_rank_of("confidence", CONFIDENCE_RANK, 0)), "step", "note_id")
        out = out.union(stats.select(F.lit(name).alias("ordering"), "note_id", F.row_number().over(order).alias("rank")))
    return out


def issues(notes: DataFrame, scores: DataFrame, templates: DataFrame, chronic: DataFrame) -> DataFrame:
    """The ranked notes; chronic only if every template cited is."""
    ranked = rank_notes(notes, scores, templates)
    cited = notes.select("note_id", F.explode("template_ids").alias("template_id"))
    marked = cited.join(chronic.select("template_id", F.lit(True).alias("c")), "template_id", "left").groupBy("note_id").agg(F.min(F.coalesce("c", F.lit(False))).alias("chronic"))
    return ranked.join(marked, "note_id", "left").select("rank", "note_id", "note", "step", "confidence", "template_ids", "top_score", "synthesis", "role", F.coalesce("chronic", F.lit(False)).alias("chronic"))


def uncited_signal(signal: DataFrame, notes: DataFrame, chronic: DataFrame) -> DataFrame:
    """template_id, chronic: signal templates that no note cites."""
    cited = notes.select(F.explode("template_ids").alias("template_id")).distinct()
    left = signal.select("template_id").join(cited, "template_id", "left_anti")
    return left.join(chronic.select("template_id", F.lit(True).alias("c")), "template_id", "left").select("template_id", F.coalesce("c", F.lit(False)).alias("chronic"))


def unopened(templates: DataFrame, notes: DataFrame, shown: DataFrame, digest: int = 40, limit: int = 3) -> DataFrame:
    """The first digest templates that were neither opened nor cited."""
    cited = notes.select(F.explode("template_ids").alias("template_id"))
    top = reads.top_templates(templates, digest, "anomaly_score")
    return top.join(cited, "template_id", "left_anti").join(shown.select("template_id"), "template_id", "left_anti").orderBy(F.desc("anomaly_score"), F.desc("occurrence_count"), "template_id").limit(limit)


def paired(objections: DataFrame, replies: DataFrame) -> DataFrame:
    """Objections with their replies by id; an objection without one stays, so does a reply without an objection."""
    last = replies.groupBy("objection_id").agg(F.max_by("response", "position").alias("response"), F.max_by("conceded", "position").alias("conceded"))
    return objections.join(last, "objection_id", "full_outer").select(
        F.coalesce(F.nullif("objection_id", F.lit("")), F.lit("unmatched")).alias("objection_id"), F.coalesce("claim", F.lit("")).alias("claim"),
        F.coalesce("severity", F.lit("unmatched_response")).alias("severity"), "response", "conceded",
    )


def marker_ranks(markers: DataFrame, events: DataFrame, templates: DataFrame) -> DataFrame:
    """marker, rank: the best place in the digest order of a template whose events hold the marker (null if none)."""
    order = [F.desc("anomaly_score"), F.desc("occurrence_count"), F.col("template_id")]
    ranks = numbered(templates.select("template_id", "anomaly_score", "occurrence_count"), order, "rank").select("template_id", F.col("rank").cast("int").alias("rank"))
    hits = search.holders(events, markers, "template_id")
    return markers.join(hits.join(ranks, "template_id").groupBy("marker").agg(F.min("rank").alias("rank")), "marker", "left")


def critique(notes: DataFrame, events: DataFrame, templates: DataFrame, signal: DataFrame, chronic: DataFrame, thin_share: float = THIN_SHARE) -> DataFrame:
    """check_name, note_id: objections that need no model.

    Broken citations; no signal template cited at all; a note that rests on chronic templates only; one that
    rests on a sliver of the events.  The last two hold only where the log can tell them apart, and notes that
    account for templates they were handed are exempt.
    """
    # Each is looked at several times and has a row per template at most: they are computed once.
    signal, chronic, templates = written(signal.select("template_id")), written(chronic.select("template_id")), written(templates.select("template_id", "occurrence_count"))
    broken = broken_citations(notes, events, templates).select(F.lit("nonexistent-citation").alias("check_name"), "note_id").distinct()
    cited = notes.select("note_id", "role", F.explode("template_ids").alias("template_id"))
    touched = cited.join(signal.select("template_id"), "template_id", "left_semi").agg(F.count("*").alias("t"))
    some = signal.agg(F.count("*").alias("s"))
    ignored = some.join(touched, F.lit(True)).where("s > 0 and t = 0").select(F.lit("signal-ignored").alias("check_name"), F.lit(None).cast("long").alias("note_id"))
    total = events.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    covers = signal.select("template_id").join(templates.select("template_id", "occurrence_count"), "template_id").agg(F.sum("occurrence_count").alias("signal_events"))
    acute = signal.select("template_id").join(chronic.select("template_id"), "template_id", "left_anti").agg(F.count("*").alias("acute"))
    facts = total.join(covers, F.lit(True)).join(acute, F.lit(True)).join(some, F.lit(True)).join(chronic.agg(F.count("*").alias("n_chronic")), F.lit(True))
    facts = facts.select(
        "total", (F.coalesce(F.col("signal_events") / F.col("total"), F.when(F.col("s") > 0, 0.0).otherwise(1.0)) >= thin_share).alias("thin_applies"),
        ((F.col("n_chronic") > 0) & ((F.col("s") == 0) | (F.col("acute") > 0))).alias("chronic_applies"),
    )
    marks = chronic.select("template_id", F.lit(True).alias("c"))
    per = cited.where(F.coalesce("role", F.lit("finding")) != "accounting").join(marks, "template_id", "left").join(templates.select("template_id", "occurrence_count"), "template_id", "left")
    per = per.groupBy("note_id").agg(F.min(F.coalesce("c", F.lit(False))).alias("only_chronic"), F.coalesce(F.sum("occurrence_count"), F.lit(0)).alias("covered")).join(F.broadcast(facts), F.lit(True))
    rests = per.where("chronic_applies and only_chronic").select(F.lit("chronic-as-cause").alias("check_name"), "note_id")
    thin = per.where((F.col("thin_applies")) & (F.col("covered") > 0) & (F.col("covered") / F.col("total") < thin_share)).select(F.lit("thin-evidence").alias("check_name"), "note_id")
    return broken.union(ignored).union(rests).union(thin)


def seeded_targets(templates: DataFrame, signal: DataFrame, chronic: DataFrame, events: DataFrame, thin_share: float = THIN_SHARE) -> DataFrame:
    """name, template_id: the template that each deliberately unsound conclusion rests on, where the log has one."""
    pick = lambda rows, name, *order: rows.orderBy(*order).limit(1).select(F.lit(name).alias("name"), "template_id")
    outside = templates.join(signal.select("template_id"), "template_id", "left_anti")
    some = signal.limit(1).select(F.lit(True).alias("_any"))
    total = F.broadcast(events.agg(F.count("*").alias("_total")))
    rarest = templates.where("occurrence_count > 0").orderBy("occurrence_count", "template_id").limit(1).join(total, F.lit(True)).where(F.col("occurrence_count") / F.col("_total") < thin_share)
    ghost = templates.agg((F.max("template_id") + 1000).alias("template_id")).where("template_id is not null").select(F.lit("fabricated-citation").alias("name"), "template_id")
    return (
        pick(templates.join(chronic.select("template_id"), "template_id", "left_semi"), "chronic-as-acute", F.desc("occurrence_count"), "template_id")
        .union(pick(outside.where("occurrence_count >= 2").join(F.broadcast(some), F.lit(True)), "volume-led", F.desc("occurrence_count"), "template_id"))
        .union(rarest.select(F.lit("thin-evidence").alias("name"), "template_id")).union(ghost)
        .union(pick(outside.join(F.broadcast(some), F.lit(True)), "signal-ignored", "anomaly_score", "template_id"))
    )


def sound_conclusions(templates: DataFrame, signal: DataFrame, chronic: DataFrame, most_chronic: int = 5) -> DataFrame:
    """name, role, place, template_id: the citations of two conclusions that no check may object to.

    ``signal-accounted`` rests on every signal template in rank order; ``chronic-dismissed`` does too, and sets the first chronic
    templates aside in a note of its own.  Without a signal there is neither, without chronic templates only the first.
    """
    ranked = signal.join(templates.select("template_id"), "template_id", "left_semi").select(F.lit("finding").alias("role"), F.col("rank").cast("long").alias("place"), "template_id")
    order = Window.orderBy("template_id")
    few = chronic.select("template_id").orderBy("template_id").limit(most_chronic)  # a top-k; the window has that many rows
    aside = few.select(F.lit("accounting").alias("role"), F.row_number().over(order).cast("long").alias("place"), "template_id")
    both = ranked.join(chronic.select(F.lit(True).alias("_any")).limit(1), F.lit(True)).drop("_any").union(aside.join(ranked.select(F.lit(True).alias("_any")).limit(1), F.lit(True)).drop("_any"))
    named = lambda rows, name: rows.select(F.lit(name).alias("name"), "role", "place", "template_id")
    return named(ranked, "signal-accounted").union(named(both, "chronic-dismissed"))


def unseen_citations(notes: DataFrame, seen: DataFrame) -> DataFrame:
    """note_id, log_event_id: cited events that no read has shown."""
    return notes.select("note_id", F.explode("log_event_ids").alias("log_event_id")).distinct().join(seen.select(F.col("id").alias("log_event_id")), "log_event_id", "left_anti").select("note_id", "log_event_id")
