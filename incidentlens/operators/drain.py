"""Drain templates over a table of messages.

The algorithm (fixed-depth tree: token count, then leading tokens, then similarity) is sequential in the order of lines, but
a line matters to later ones only if it changes the tree: by a new template or a new wildcard.  Few lines do, so

1. candidates (of every message with its numbers masked a few different lines) are clustered by themselves, in line order, a task
   per token count; those that change the tree are its *log*;
2. all lines are validated in parallel: each is looked up in the tree as the log left it before that line.  A line that would have
   changed that tree was missed, and becomes a candidate;
3. token counts with missed lines are clustered and validated again, until none is missed.

When no line is missed, the log is what one pass over all lines would have done, so numbers and patterns are those of the
serial algorithm.  The first missed line of a token count is right from the next round on, so rounds end.  The log is also the tree's state: with it
alone, clustering goes on with further lines.  A token count that needs a long log, too many rounds, or more templates
than the cap (which makes results depend on every line's recency) is clustered serially, in a task of its own.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens.functions import texts
from incidentlens.operators.ranks import numbered, written

WILD, STATE_VERSION = "<*>", 1
#: Lines whose log may go to every task: of one token count, and of all together.
LOG_LINES, LOG_TOTAL, LOG_BYTES, ROUNDS = 20_000, 100_000, 32 << 20, 12
#: Messages of a token count whose cluster a task keeps in mind.
MEMO = 2_000
STATE = "n_tokens int, line long, text string"
#: White space as str.split() has it.
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


#: Ids that no token of a line has: of a wildcard, of a token that no template holds, and of a template that was evicted.
_ANY, _NEW, _GONE = -1, -2, -3
#: Tokens that a tree numbers before it forgets those that no template holds any more.
VOCABULARY = 1 << 20
#: Rows of a leaf that are compared one and all before they are indexed.
INDEX_ROWS = 512


class _Leaf:
    """A leaf's templates as rows of token ids, in the order they were made.

    Only templates with ``need`` tokens of a line are looked for.  Such a template shares one of any ``width - need + 1`` places with it, so an index
    from (place, token) to rows gives all that come into question at the line's rarest places; rows that were made since it was built are all compared.
    The index may name rows that lost the token since, never lack one that has it.
    """

    __slots__ = ("numbers", "rows", "wild", "gone", "need", "base", "indexed", "keys", "starts", "held")

    def __init__(self, width: int, need: int):
        self.numbers: list[int] = []
        self.rows, self.wild, self.gone = np.empty((2, width), dtype=np.int32), np.empty(2, dtype=np.int64), 0
        self.need, self.base = need, np.arange(width, dtype=np.int64) << 32
        self.unindex()

    def put(self, number: int, row: np.ndarray) -> int:
        at = len(self.numbers)
        if at == len(self.rows):
            self.rows, self.wild = np.concatenate([self.rows, self.rows]), np.concatenate([self.wild, self.wild])
        self.rows[at], self.wild[at] = row, (row == _ANY).sum()
        self.numbers.append(number)
        return at

    def drop(self, at: int) -> None:
        """An evicted template: it equals nothing, and scores below all others."""
        self.rows[at], self.wild[at], self.gone = _GONE, -1 << 40, self.gone + 1

    def unindex(self) -> None:
        """Forgets the index: rows or ids of tokens are others now."""
        self.indexed, self.keys, self.starts, self.held = 0, None, None, None

    def _index(self, n: int) -> None:
        """Of each place in turn the tokens, and the rows that have them."""
        keys, starts, held, before = [], [], [], 0
        for base, column in zip(self.base, self.rows[:n].T, strict=True):
            rows = np.flatnonzero(column >= 0)
            rows = rows[np.argsort(column[rows], kind="stable")].astype(np.int32)
            tokens = column[rows]
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(rows) else rows
            keys.append(tokens[first] + base)
            starts.append(first + before)
            held.append(rows)
            before += len(rows)
        self.indexed, self.keys, self.held = n, np.concatenate(keys), np.concatenate(held)
        self.starts = np.append(np.concatenate(starts), before)

    def _likely(self, row: np.ndarray) -> np.ndarray | None:
        """Indexed rows that may have ``need`` tokens of this one; None where comparing all is less work."""
        want = (self.base + row)[row >= 0]
        at = np.searchsorted(self.keys, want)
        at = at[self.keys[np.minimum(at, len(self.keys) - 1)] == want] if len(self.keys) else at[:0]
        if len(at) < self.need:
            return self.held[:0]
        begin, end = self.starts[at], self.starts[at + 1]
        rare = np.argsort(end - begin, kind="stable")[: len(at) - self.need + 1]  # of the places where no row has the token none is needed
        if int((end - begin)[rare].sum()) > self.indexed // 2:
            return None
        return np.unique(np.concatenate([self.held[b:e] for b, e in zip(begin[rare].tolist(), end[rare].tolist(), strict=True)]))

    def _top(self, row: np.ndarray, rows: np.ndarray, wild: np.ndarray) -> tuple[int, int, int]:
        """(score, place, equal tokens) of the first of these rows with most equal tokens, and of those with most wildcards."""
        same = np.count_nonzero(rows == row, axis=1)
        score = same * (len(row) + 1) + wild
        at = int(score.argmax())
        return int(score[at]), at, int(same[at])

    def best(self, row: np.ndarray) -> int | None:
        """The number of the template with most equal tokens, of those with most wildcards the first one; None if it has fewer than ``need``."""
        n = len(self.numbers)
        if n == self.gone:
            return None
        if self.need > 0 and n - self.indexed > max(INDEX_ROWS, self.indexed // 4):
            self._index(n)
        likely = self._likely(row) if self.indexed else None
        if likely is None:
            _, at, same = self._top(row, self.rows[:n], self.wild[:n])
            return self.numbers[at] if same >= self.need else None
        found = []
        if len(likely):
            score, at, same = self._top(row, self.rows[likely], self.wild[likely])
            found.append((score, int(likely[at]), same))
        if self.indexed < n:
            score, at, same = self._top(row, self.rows[self.indexed : n], self.wild[self.indexed : n])
            found.append((score, at + self.indexed, same))
        _, at, same = max(found, key=lambda x: x[0], default=(0, 0, -1))  # the first of equals is the earlier row
        return self.numbers[at] if same >= self.need else None


class Drain:
    """One tree for messages of any length; ``add`` returns the message's cluster number."""

    def __init__(self, sim_th: float = 0.4, depth: int = 4, max_children: int = 100, max_clusters: int = 10_000):
        if not 0 < sim_th <= 1 or depth < 3 or max_children < 1 or max_clusters < 1:
            raise ValueError("need 0 < sim_th <= 1, depth >= 3, and positive caps")
        self.sim_th, self.levels, self.max_children, self.max_clusters = sim_th, depth - 3, max_children, max_clusters
        self.root: dict[int, dict] = {}
        self.clusters: OrderedDict[int, list[str]] = OrderedDict()  # least recently used first
        self.made, self.evicted = 0, 0
        self.last_evicted: tuple[int, list[str]] | None = None
        self.places: dict[int, tuple[_Leaf, int]] = {}  # each cluster's leaf and row
        self.ids: dict[str, int] = {}
        self.words: list[str] = []
        self.room = VOCABULARY
        self.looked_up: tuple[list[str] | None, np.ndarray | None] = None, None  # the tokens that were searched for last, and their ids

    def _leaf(self, tokens: list[str], grow: bool) -> _Leaf | None:
        node = self.root.get(len(tokens))
        if node is None:
            if not grow:
                return None
            node = self.root[len(tokens)] = {}
        for token in tokens[: self.levels + 1]:
            if token in node:
                node = node[token]
                continue
            if not grow:
                if WILD not in node:
                    return None
                node = node[WILD]
                continue
            key = WILD if any(c.isdigit() for c in token) else token
            if key != WILD and key not in node and len(node) + (WILD not in node) >= self.max_children:
                key = WILD
            node = node.setdefault(key, {})
        if grow and "" not in node:
            node[""] = _Leaf(len(tokens), self._need(len(tokens)))
        return node.get("")

    def _best(self, tokens: list[str]) -> int | None:
        leaf = self._leaf(tokens, False)
        if leaf is None:
            return None
        self.looked_up = tokens, self._known(tokens)
        return leaf.best(self.looked_up[1])

    def _known(self, tokens: list[str]) -> np.ndarray:
        """The tokens' ids; a wildcard of a line has none."""
        return np.fromiter(map(self.ids.get, tokens, repeat(_NEW)), np.int32, len(tokens))

    def _need(self, width: int) -> int:
        """The fewest equal tokens that make a line of ``width`` similar enough."""
        return next(same for same in range(width + 1) if (same / width if width else 1.0) >= self.sim_th)

    def _numbered(self, tokens: list[str]) -> np.ndarray:
        """The tokens' ids, new ones for new tokens."""
        row = self.looked_up[1] if tokens is self.looked_up[0] else self._known(tokens)
        for i in np.flatnonzero(row == _NEW).tolist():
            t = tokens[i]
            if t == WILD:
                row[i] = _ANY
                continue
            if t not in self.ids:
                self.ids[t] = len(self.words)
                self.words.append(t)
            row[i] = self.ids[t]
        return row

    def _forget(self) -> None:
        """Numbers the tokens of the present templates anew."""
        self.ids, self.words, self.looked_up = {}, [], (None, None)
        for leaf in {id(leaf): leaf for leaf, _ in self.places.values()}.values():
            leaf.unindex()
        for number, (leaf, at) in self.places.items():
            leaf.rows[at] = self._numbered(self.clusters[number])
        self.room = max(VOCABULARY, 2 * len(self.words))

    def missed(self, tokens: list[str]) -> tuple[int | None, tuple[int, ...]]:
        """(the cluster that the tokens would join, places that they would make wild): what ``add`` would do, undone."""
        number = self._best(tokens)
        if number is None:
            return None, ()
        return number, tuple(i for i, (a, b) in enumerate(zip(self.clusters[number], tokens, strict=True)) if a != b and a != WILD)

    def add(self, tokens: list[str]) -> int:
        return self.take(tokens, self._best(tokens))

    def take(self, tokens: list[str], number: int | None) -> int:
        """Adds tokens whose cluster is known (None: a new one), without searching for it."""
        if number is None:
            number = self.made
            self.made += 1
            leaf, row = self._leaf(tokens, True), self._numbered(tokens)
            self.clusters[number] = [self.words[i] if i >= 0 else WILD for i in row.tolist()]  # each token is held once
            self.places[number] = leaf, leaf.put(number, row)
            if len(self.clusters) > self.max_clusters:
                self.last_evicted = self.clusters.popitem(last=False)
                self._evict(self.last_evicted[0])
            if len(self.words) > self.room:
                self._forget()
            return number
        template, (leaf, at) = self.clusters[number], self.places[number]
        for i, (a, b) in enumerate(zip(template, tokens, strict=True)):
            if a != b and a != WILD:
                template[i], leaf.rows[at, i] = WILD, _ANY
                leaf.wild[at] += 1
        self.clusters.move_to_end(number)
        return number

    def _evict(self, number: int) -> None:
        leaf, at = self.places.pop(number)
        leaf.drop(at)
        self.evicted += 1
        if 2 * leaf.gone > len(leaf.numbers):
            kept = [i for i, n in enumerate(leaf.numbers) if n in self.clusters]
            leaf.rows, leaf.wild, leaf.gone = leaf.rows[[*kept, 0, 0]], leaf.wild[[*kept, 0, 0]], 0
            leaf.numbers = [leaf.numbers[i] for i in kept]
            leaf.unindex()
            self.places.update((n, (leaf, i)) for i, n in enumerate(leaf.numbers))


def cluster_serially(messages: Iterable[str], **options) -> tuple[list[int], dict[int, str]]:
    """(cluster of each message, pattern by cluster): the whole sequence through one tree."""
    tree, numbers, patterns = Drain(**options), [], {}
    for message in messages:
        number = tree.add(message.split())
        numbers.append(number)
        patterns[number] = " ".join(tree.clusters[number])
    return numbers, patterns


class StartOver(ValueError):
    """A state that can't go on with these lines: all lines have to be clustered from the first."""


@dataclass
class Clustered:
    """``lines``: (order, template_id, pattern) of every line; ``templates``: (template_id, first, pattern), also those that only earlier lines have;
    ``state``: the log, from which ``cluster_on`` goes on; ``serial``: the token counts that were clustered serially."""

    lines: DataFrame
    templates: DataFrame
    state: DataFrame
    serial: list[int]


def token_count(text: Column) -> Column:
    parts = F.split(text, _SPACE)
    return F.size(F.filter(parts, lambda t: t != ""))


def _rows(lines: DataFrame, order: str, text: str) -> DataFrame:
    rows = lines.select(F.col(order).cast("long").alias("line"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select(token_count(F.col("text")).alias("n_tokens"), "line", "text")


def _candidates(rows: DataFrame) -> DataFrame:
    """Of each message with masked numbers up to four lines with different texts, and of those the first."""
    masked = F.xxhash64(F.regexp_replace("text", r"\S*\d\S*", WILD))
    kinds = rows.groupBy("n_tokens", masked.alias("_m"), F.pmod(F.xxhash64("text"), F.lit(4)).alias("_k")).agg(F.min("line").alias("line"), F.min_by("text", "line").alias("text"))
    return kinds.select("n_tokens", "line", "text")


def _dealt(rows: DataFrame) -> DataFrame:
    """A token count's rows in one task and in order.  The number of tasks is given: by size alone Spark would put short rows with much work into a few."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "n_tokens").sortWithinPartitions("n_tokens", "line")


def _replayed(candidates: DataFrame, cap: int, options: dict) -> DataFrame:
    """(n_tokens, line, text, local, made, pattern) of the lines that change the tree; one task has all candidates of a token count.

    It stops at a token count that grows past ``cap`` templates or LOG_LINES changes: those are clustered serially.
    """
    placed = _dealt(candidates)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, last, changes = None, None, 0
        for batch in batches:
            out = []
            for n, line, message in zip(batch["n_tokens"], batch["line"], batch["text"], strict=True):
                if n != last:
                    tree, last, changes = Drain(**options), n, 0
                if tree.made > cap or changes > LOG_LINES:
                    continue
                tokens = message.split()
                number, wild = tree.missed(tokens)
                if number is None or wild:
                    made = number is None
                    number = tree.take(tokens, number)
                    changes += 1
                    out.append((n, line, message, number, made, " ".join(tree.clusters[number])))
            yield pd.DataFrame(out, columns=["n_tokens", "line", "text", "local", "made", "pattern"])

    return placed.mapInPandas(each, "n_tokens int, line long, text string, local long, made boolean, pattern string")


def _masked(token: str) -> str:
    return WILD if any(c.isdigit() for c in token) else token


def _taken(tree: Drain, logged: tuple) -> int:
    tokens = logged[1].split()
    return tree.take(tokens, logged[2]) if len(logged) > 2 else tree.add(tokens)


def _validated(rows: DataFrame, logs: dict[int, list[tuple]], options: dict) -> DataFrame:
    """(n_tokens, line, local, effect, text) of the rows whose token count has a log.

    ``effect`` names what a missed line would have changed (null where it changes nothing); only missed lines carry their text.
    A task walks its rows in line order and lets each tree take in its log up to the line; where rows go back, the tree starts anew.
    A log's line is (line, text) or (line, text, its cluster, None for a new one), which spares the search.
    """
    shared = rows.sparkSession.sparkContext.broadcast(logs)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[int, tuple[Drain, int, int, dict[str, int]]] = {}  # tree, log lines taken in, last line, clusters of messages since the last change
        for batch in batches:
            batch = batch.sort_values(["n_tokens", "line"], kind="stable")
            found = []
            for n, line, message in zip(batch["n_tokens"].tolist(), batch["line"].tolist(), batch["text"], strict=True):
                log = shared.value[n]
                tree, at, before, memo = trees.get(n) or (Drain(**options), 0, line, {})
                if line < before:
                    tree, at, memo = Drain(**options), 0, {}
                while at < len(log) and log[at][0] < line:
                    _taken(tree, log[at])
                    at, memo = at + 1, {}
                if at < len(log) and log[at][0] == line:
                    number, wild = _taken(tree, log[at]), ()
                    at, memo = at + 1, {}
                else:
                    known = memo.get(message)
                    number, wild = (known, ()) if known is not None else tree.missed(message.split())
                    if number is not None and not wild:
                        if len(memo) > MEMO:
                            memo = {}
                        memo[message] = number
                trees[n] = (tree, at, line, memo)
                effect = None
                if number is None:
                    tokens = [_masked(t) for t in message.split()]
                    effect = "new " + " ".join(tokens[: tree.levels + 1]) + f" {zlib.crc32(' '.join(tokens).encode('utf-8', 'surrogatepass')) % 8}"
                elif wild:
                    effect = f"{number} {wild}"
                found.append((n, line, number, effect, None if effect is None else message))
            yield pd.DataFrame(found, columns=["n_tokens", "line", "local", "effect", "text"]).astype({"local": "Int64"})

    known = list(logs)
    return rows.where(F.col("n_tokens").isin(known)).mapInPandas(each, "n_tokens int, line long, local long, effect string, text string")


def _serially(rows: DataFrame, options: dict) -> DataFrame:
    """(n_tokens, line, local, pattern), a token count at a time; a group arrives as a stream of batches, so only its tree is held.

    A row without a pattern is a line; one with a pattern is a template and its first line, written when it is evicted or its token count ends.
    """
    placed = _dealt(rows)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, last, firsts = Drain(**options), None, {}

        def ended(out: list) -> None:
            out += [(last, firsts[number], number, " ".join(tokens)) for number, tokens in tree.clusters.items()]

        for batch in batches:
            out = []
            for n, line, message in zip(batch["n_tokens"].tolist(), batch["line"].tolist(), batch["text"], strict=True):
                if n != last:
                    ended(out)
                    tree, last, firsts = Drain(**options), n, {}
                made, evicted = tree.made, tree.evicted
                number = tree.add(message.split())
                if tree.made > made:
                    firsts[number] = line
                if tree.evicted > evicted:
                    old, tokens = tree.last_evicted
                    out.append((n, firsts.pop(old), old, " ".join(tokens)))
                out.append((n, line, number, None))
            yield pd.DataFrame(out, columns=["n_tokens", "line", "local", "pattern"])
        out = []
        ended(out)
        yield pd.DataFrame(out, columns=["n_tokens", "line", "local", "pattern"])

    return placed.mapInPandas(each, "n_tokens int, line long, local long, pattern string")


def _affordable(changes: DataFrame, cap: int) -> tuple[list[int], list[int]]:
    """Token counts whose logs may be sent to every task, shortest first while they fit together; and the others."""
    sizes = changes.groupBy("n_tokens").agg(F.count("*").alias("n"), F.count_if("made").alias("made"), F.sum(F.octet_length("text") + 64).alias("bytes")).collect()  # a row per token count
    fit, rest, lines, volume = [], [], 0, 0
    for r in sorted(sizes, key=lambda r: (r["n"], r["n_tokens"])):
        lines, volume = lines + r["n"], volume + r["bytes"]
        over = r["made"] > cap or r["n"] > LOG_LINES or lines > LOG_TOTAL or volume > LOG_BYTES
        (rest if over else fit).append(r["n_tokens"])
    return fit, rest


def cluster_on(lines: DataFrame, state: DataFrame | None = None, order: str = "id", text: str = "message", **options) -> Clustered:
    """Clusters ``lines``, going on from ``state`` (of an earlier run whose lines all come before these).

    Template ids count from 1 by a template's first line.  The cluster cap holds per token count.
    """
    spark = lines.sparkSession
    limit = Drain(**options)  # refuses bad options here rather than in a task
    cap, free = limit.max_clusters, options | {"max_clusters": 1 << 60}
    rows = written(_rows(lines, order, text))
    candidates, serial, done, heads, logs = _candidates(rows), [], [], [], []
    if state is not None:
        end, first = state.agg(F.max("line")).first()[0], rows.agg(F.min("line")).first()[0]
        if end is not None and first is not None and first <= end:
            raise ValueError(f"line {first} isn't behind the state's last, {end}")
        candidates = candidates.union(state.select("n_tokens", "line", "text"))
    for _ in range(ROUNDS):
        changes = written(_replayed(candidates, cap, free))
        fit, over = _affordable(changes, cap)
        serial += over
        kept = sorted(changes.where(F.col("n_tokens").isin(fit)).collect(), key=lambda r: r["line"])  # LOG_TOTAL lines at most
        by_count: dict[int, list] = {n: [] for n in fit}
        for r in kept:
            by_count[r["n_tokens"]].append(r)
        checked = written(_validated(rows, {n: [(r["line"], r["text"], None if r["made"] else r["local"]) for r in log] for n, log in by_count.items()}, free))
        missed = checked.where("effect is not null").groupBy("n_tokens", "effect").agg(F.min("line").alias("line"), F.min_by("text", "line").alias("text"))
        missed = written(missed.select("n_tokens", "line", "text"))
        again = [r["n_tokens"] for r in missed.select("n_tokens").distinct().collect()]  # a row per token count
        settled = [n for n in fit if n not in again]
        done.append(checked.where(F.col("n_tokens").isin(settled)).select("n_tokens", "line", "local"))
        for n in settled:
            latest = {r["local"]: r["pattern"] for r in by_count[n]}
            heads += [(n, r["local"], r["line"], latest[r["local"]]) for r in by_count[n] if r["made"]]
            logs += [(n, r["line"], r["text"]) for r in by_count[n]]
        if not again:
            break
        candidates = missed.union(spark.createDataFrame([(n, r["line"], r["text"]) for n in again for r in by_count[n]], STATE))
    else:
        serial += again
    if state is not None and not state.where(F.col("n_tokens").isin(serial)).isEmpty():
        raise StartOver(f"token counts {sorted(serial)} have to be clustered from their first line")
    return _assembled(spark, rows, done, heads, logs, serial, order, options)


def _assembled(spark, rows, done, heads, logs, serial, order, options) -> Clustered:
    known = spark.createDataFrame(heads, "n_tokens int, local long, first long, pattern string")
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    if serial:
        one_by_one = written(_serially(rows.where(F.col("n_tokens").isin(serial)), options))
        found = found.union(one_by_one.where("pattern is null").select("n_tokens", "line", "local"))
        known = known.union(one_by_one.where("pattern is not null").select("n_tokens", "local", F.col("line").alias("first"), "pattern"))
    templates = numbered(known, ["first"], "template_id")
    labelled = found.join(templates.select("n_tokens", "local", "template_id", "pattern"), ["n_tokens", "local"])
    # A token count that was clustered serially has no log: its one row without text says that it can't go on.
    state = spark.createDataFrame(logs + [(n, 0, None) for n in serial], STATE)
    return Clustered(labelled.select(F.col("line").alias(order), "template_id", "pattern"), templates.select("template_id", "first", "pattern"), state, sorted(serial))


def cluster(lines: DataFrame, order: str = "id", text: str = "message", **options) -> DataFrame:
    """(order, template_id, pattern) of every line; pattern is the template's latest one.  See ``cluster_on``."""
    return cluster_on(lines, None, order, text, **options).lines


def stamped(state: DataFrame, **options) -> DataFrame:
    """The state with what it holds for: a version and the tree's options in every row."""
    tree = Drain(**options)
    return state.select(
        F.lit(STATE_VERSION).alias("version"), F.lit(float(tree.sim_th)).alias("sim_th"), F.lit(tree.levels + 3).alias("depth"),
        F.lit(tree.max_children).alias("max_children"), F.lit(tree.max_clusters).alias("max_clusters"), *state.columns,
    )


def usable(stored: DataFrame | None, **options) -> DataFrame | None:
    """A stored state to go on from; None where it is missing, damaged, of another version or other options, or can't go on: then cluster anew."""
    if stored is None or not {"version", "sim_th", "depth", "max_children", "max_clusters", "n_tokens", "line", "text"} <= set(stored.columns):
        return None
    tree = Drain(**options)
    fits = (
        (F.col("version") == STATE_VERSION) & (F.col("sim_th") == float(tree.sim_th)) & (F.col("depth") == tree.levels + 3) & (F.col("max_children") == tree.max_children)
        & (F.col("max_clusters") == tree.max_clusters) & F.col("text").isNotNull() & (token_count(F.col("text")) == F.col("n_tokens")) & F.col("line").isNotNull()
    )
    try:
        if not stored.where(~F.coalesce(fits, F.lit(False))).isEmpty():
            return None
    except Exception as e:  # unreadable files or columns of other types: as good as none
        if "pyspark" not in type(e).__module__ and "py4j" not in type(e).__module__:
            raise
        return None
    return stored.select(F.col("n_tokens").cast("int").alias("n_tokens"), F.col("line").cast("long").alias("line"), F.col("text").cast("string").alias("text"))


# ---- calibration of the similarity threshold, on a bounded sample

CANDIDATES, SAMPLE, UPPER_RATIO = (0.3, 0.4, 0.5), 2000, 0.30


def wildcard_heavy(pattern: str) -> bool:
    tokens = pattern.split()
    return len(tokens) >= 3 and sum(t == WILD for t in tokens) / len(tokens) > 0.6


def calibrate(messages: list[str], candidates: tuple[float, ...] = CANDIDATES, upper: float = UPPER_RATIO, **options) -> dict:
    """The candidate with the fewest templates among those without wildcard-heavy ones; a tie goes to the stricter.

    status: selected, under_clustered (more templates than ``upper`` of the lines even so), signal_at_risk (every
    candidate makes wildcard-heavy templates), skipped (no messages).
    """
    if not messages:
        return {"status": "skipped", "sim_th": None, "templates": 0}
    tried = []
    for th in candidates:
        _, patterns = cluster_serially(messages, sim_th=th, **options)
        tried.append((th, len(patterns), any(wildcard_heavy(p) for p in patterns.values())))
    safe = [t for t in tried if not t[2]]
    if not safe:
        th, n, _ = max(tried)
        return {"status": "signal_at_risk", "sim_th": th, "templates": n}
    th, n, _ = min(safe, key=lambda t: (t[1], -t[0]))
    return {"status": "under_clustered" if n / len(messages) > upper else "selected", "sim_th": th, "templates": n}


def parameters(lines: DataFrame, text: str = "message") -> DataFrame:
    """``lines`` (with pattern) and ``params``: the tokens that stand where the pattern has a wildcard."""
    both = F.arrays_zip(texts.tokens(F.col("pattern")).alias("p"), texts.tokens(F.col(text)).alias("t"))
    return lines.withColumn("params", F.transform(F.filter(both, lambda x: x["p"] == WILD), lambda x: x["t"]))
