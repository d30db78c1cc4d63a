"""Quality rules as a short-circuit cascade, by DataFrame functions only.

Each rule is an expression that is true where it rejects a text.  On a sample every rule is timed and the
pattern of its rejections counted; rules are then put in the order that rejects most per cost among the rows that earlier
ones leave, and evaluated as nested conditions, so a row pays for no rule behind the first that
rejects it.  The order never changes a verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens.llm.common import drop, materialize

#: Rows that the costs are estimated on: about SAMPLE of them, never over twice as many.
SAMPLE, RUNS = 2000, 3
WINDOW = 8
_SPACES = " \t\n\x0b\f\r"
_BETWEEN = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over ``text`` (never null) and the base measures."""

    name: str
    rejects: str


_LINES = r"filter(split(text, '\n'), l -> translate(l, ' \t\n\u000b\f\r', '') != '')"

#: Beside the base.  Thresholds are wide: a rule is meant for what no reader would call prose.
RULES = (
    Rule("word_length", "word_chars > 25 * n_words"),
    Rule("symbols", "2 * n_symbols > word_chars"),
    Rule("few_letters", r"10 * length(regexp_replace(text, '\\P{L}+', '')) < 3 * word_chars"),
    Rule("broken_characters", r"100 * (length(text) - length(translate(text, '�\u0000', ''))) > length(text)"),
    Rule("repeated_lines", f"2 * size(array_distinct({_LINES})) < size({_LINES}) and size({_LINES}) >= 10"),
    Rule("ellipsis_lines", f"10 * size(filter({_LINES}, l -> rtrim(l) rlike '(…|[.]{{3}})$')) > 9 * size({_LINES}) and size({_LINES}) >= 10"),
)


def words(text: Column) -> Column:
    """The words of a text, in order: what lies between spaces, tabs and line ends."""
    return F.filter(F.split(text, _BETWEEN), lambda w: w != "")


def repeated_words(listed: Column, width: int = WINDOW) -> Column:
    """How many words stand in a window of ``width`` words (a power of two) that the text holds twice or more.

    Windows are compared by 64-bit hashes and sorted with their places, so time grows with n log n.  Of the places of
    repeated windows, in order, each covers up to the next one or ``width`` words.
    """
    def bound(value: Column, use) -> Column:
        """``use`` of ``value``, which is computed once however often it is used."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def doubled(step: int):
        """Hashes of 2 * step words from those of step words."""
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    windows, step = F.transform(listed, lambda w: F.xxhash64(w)), 1
    while step < width:
        windows, step = bound(windows, doubled(step)), 2 * step
    windows = F.slice(windows, F.lit(1), F.size(listed) - width + 1)

    def places(w: Column) -> Column:
        # one array, bound once: neighbours in the order of hashes that are equal
        twice = F.transform(w, lambda x, i: F.when((F.get(w, i - 1)["h"] == x["h"]) | (F.get(w, i + 1)["h"] == x["h"]), x["at"]))
        return F.sort_array(F.filter(twice, lambda at: at.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)

    found = bound(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
        bound(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), lambda s: bound(places(s), covered))
    ))
    return F.when(F.size(listed) <= width, F.lit(0).cast("long")).otherwise(found)


def measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (null as empty), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("_words", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda line: F.translate(line, _SPACES, "") != "")
    rows = rows.select(
        "doc_id", "text", F.size("_words").cast("long").alias("n_words"), F.length(F.translate("text", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


@dataclass(frozen=True)
class Profile:
    """``cost``: seconds of each rule over the sample; ``patterns``: rows by the set of rules that reject them."""

    cost: dict[str, float]
    patterns: dict[frozenset[str], int]


def profile(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE) -> Profile:
    """Times the rules over about ``size`` rows, chosen by a hash of the text, and counts which of them reject what."""
    total = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(7)), F.lit(max(1, total // size))) == 0).limit(2 * size)
    sample, path = materialize(measures(chosen, id_col, text_col), "rule-sample")
    flags = [F.expr(r.rejects).alias(r.name) for r in rules]
    rows = sample.select(*flags).groupBy(*[r.name for r in rules]).agg(F.count("*").alias("_n")).collect()  # 2 ** rules rows at most, of a bounded sample
    patterns = {frozenset(r.name for r in rules if row[r.name]): row["_n"] for row in rows}

    def timed(column: Column) -> float:
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            sample.agg(F.sum(column)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    idle = timed(F.length("text"))
    cost = {r.name: max(timed(F.expr(r.rejects).cast("int")) - idle, 1e-4) for r in rules}
    drop(docs.sparkSession, path)
    return Profile(cost, patterns)


def ordered(rules: tuple[Rule, ...], known: Profile) -> list[Rule]:
    """Next comes the rule that rejects most rows per second of those that the earlier ones leave; ties: the cheaper, then by name."""
    left, rest, out = dict(known.patterns), list(rules), []
    while rest:
        def worth(rule: Rule) -> tuple:
            rejected = sum(n for names, n in left.items() if rule.name in names)
            return -rejected / known.cost[rule.name], known.cost[rule.name], rule.name

        best = min(rest, key=worth)
        rest.remove(best)
        out.append(best)
        left = {names: n for names, n in left.items() if best.name not in names}
    return out


def cascade(rules: list[Rule], spared: Column) -> Column:
    """Whether a row passes all rules, asked one behind the other; ``spared`` rows fail before the first."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(F.expr(rule.rejects), False).otherwise(out)
    return F.when(spared, False).otherwise(out)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, known: Profile | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text is an empty one and fails the base.  Repeated rows and null ids are kept as rows; other columns are not read.
    ``known`` spares the estimate.  An empty table gives no rows.
    """
    known = known or profile(docs, rules, id_col, text_col)
    rows = measures(docs, id_col, text_col)
    kept = cascade(ordered(rules, known), F.col("base_failed"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
