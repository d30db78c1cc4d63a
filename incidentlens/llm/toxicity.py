"""Toxicity by maximum-scoring segments of token log-odds.

Learning (from a bounded sample of labelled rows): a token's log-odds of toxic
against clean documents under Dirichlet priors that back off from the word to its
six-, five- and four-byte beginnings and then to the base rate, so that rare
tokens say little and new endings of a known stem say much.

Scoring: a token adds its log-odds less a constant drift.  A linear-time scan finds
all maximal-scoring segments; a segment's score is turned into a significance by the
extreme-value law of the best segment among random tokens, whose two parameters
solve the usual equation on the clean documents' scores and fit their best segments.
The document's probability is a logistic function of its best normalised score and
of the sum over its significant segments, fitted on documents that the log-odds in
use there were not learned from.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm import kernels as K
from incidentlens.llm.langid import held_out

MAX_ROWS = 3_000
#: Bytes of text that are learned from at most: what the driver holds, whatever the texts' lengths.
MAX_BYTES = 96 << 20
PRIOR, DRIFT, LEAST_LOG_ODDS, ALPHA = 8.0, 0.4, 1.5, 0.05
#: Lengths of the beginnings that a word backs off through; the last level is the word itself.
STEMS = (4, 5, 6)
LEVELS = len(STEMS) + 1

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def tokens(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes of every token by level, first token of each text plus the total).

    Tokens are runs of letters, A-Z folded.  A word no longer than a stem is its own stem there.
    """
    parts, counts = [[] for _ in range(LEVELS)], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        for piece in K._pieces(K.lowered(text), K.PIECE):
            buf = np.frombuffer(piece, dtype=np.uint8)
            starts, ends = K.spans(buf, _LETTER[buf])
            counts[i] += len(starts)
            for level, hashes in enumerate(stem_hashes(buf, starts, ends)):
                parts[level].append(hashes)
    joined = [np.concatenate(p) if p else np.zeros(0, dtype=np.uint64) for p in parts]
    return joined, np.concatenate([[0], np.cumsum(counts)])


def stem_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    out = [K.span_hashes(buf, starts, np.minimum(ends, starts + n)) + np.uint64(i) for i, n in enumerate(STEMS)]
    return [*out, K.span_hashes(buf, starts, ends) + np.uint64(LEVELS)]


def all_maximal(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a sequence, in linear time.

    The sequence's positive tokens are given by the running total before (``left``) and after
    (``right``) each; what lies between only lowers the total.  Returns (first, last, score) by token index.
    """
    stack: list[list] = []  # first, last, total before, total after, index of the nearest one that starts lower
    for i in range(len(left)):
        first, lo, hi = i, float(left[i]), float(right[i])
        at = len(stack)
        while True:
            at -= 1
            while at >= 0 and stack[at][2] >= lo:
                at = stack[at][4]
            if at < 0 or stack[at][3] >= hi:
                stack.append([first, i, lo, hi, at])
                break
            first, lo = stack[at][0], stack[at][2]  # one longer segment, which takes in all since
            del stack[at:]
            at = len(stack)
    return [(a, b, hi - lo) for a, b, lo, hi, _ in stack]


class Model:
    """Feature hashes with their scores per level (hashes ascending); the extreme-value and logistic parameters.

    It holds every feature that says something: as many as the bounded sample has, whatever the corpus.
    """

    def __init__(self, features: list[tuple[np.ndarray, np.ndarray]], drift: float = DRIFT):
        self.drift = drift
        self.keys = [keys for keys, _ in features]
        self.values = [values for _, values in features]
        self.seen = []
        for keys in self.keys:
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.seen.append(seen)
        self.rate, self.size = 1.0, 0.1  # lambda and K of the extreme-value law
        self.weights = np.array([-2.0, 1.0, 1.0])

    def token_scores(self, levels: list[np.ndarray]) -> np.ndarray:
        """Log-odds of each token: that of the longest known stem, 0 if none is known."""
        out = np.zeros(len(levels[0]))
        for hashes, keys, values, seen in zip(levels, self.keys, self.values, self.seen, strict=True):
            if len(keys):
                maybe = np.flatnonzero(seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
                known = keys[at] == hashes[maybe]
                out[maybe[known]] = values[at[known]]
        return out

    def segments(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Maximal segments (first token, last token, score) of one document's tokens."""
        hits = np.flatnonzero(scores > self.drift)
        if not len(hits):
            return []
        # Tokens between hits may have known negative log-odds too: totals count every token.
        total = np.cumsum(scores - self.drift)
        found = all_maximal(total[hits] - (scores[hits] - self.drift), total[hits])
        return [(int(hits[a]), int(hits[b]), s) for a, b, s in found]

    def normalised(self, score: float, n: int) -> float:
        """lambda * score - ln(K n): its exponential's negative is the expected number of such chance segments."""
        return self.rate * score - math.log(self.size * max(1, n))

    def inputs(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        values = sorted((self.normalised(s, n) for _, _, s in segments), reverse=True)
        best = values[0] if values else self.normalised(0.0, n)
        cut = -math.log(ALPHA)
        return max(-8.0, min(best, 24.0)), math.log1p(sum(v for v in values if v > cut))

    def probability(self, inputs: tuple[float, float]) -> float:
        z = self.weights[0] + self.weights[1] * inputs[0] + self.weights[2] * inputs[1]
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))

    def score(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """(probability, significant segments) of whole texts."""
        levels, first = tokens(texts)
        scores = self.token_scores(levels)
        out, cut = [], -math.log(ALPHA)
        for i in range(len(texts)):
            n = int(first[i + 1] - first[i])
            found = self.segments(scores[first[i] : first[i + 1]])
            out.append((self.probability(self.inputs(found, n)), [s for s in found if self.normalised(s[2], n) > cut]))
        return out


class Counts:
    """Distinct contexts of every feature, per text.

    A context is a token with its neighbours: passages that many documents repeat count once, while a
    word that keeps turning up in new places counts each time.  Arrays by level: ``keys``, each key's
    ``parent`` (its place a level up), and per distinct (key, context, text) ``which`` key and ``text``.
    """

    def __init__(self, texts: list[str]):
        levels, first = tokens(texts)
        word, n = levels[-1], len(levels[-1])
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
        near = np.zeros(n + 2, dtype=np.uint64)
        near[1:-1] = word
        context = K.mix(near[:-2] * np.uint64(3) + word * np.uint64(5) + near[2:] * np.uint64(7))
        _, order = np.unique(context, return_index=True)  # a context counts for the first text that has it
        order = order.astype(np.int32)
        del near, context, word
        self.keys, self.parent, self.which, self.text = [], [], [], doc[order]
        inverse = None
        for level in range(LEVELS):
            above = inverse
            keys, index, inverse = np.unique(levels[level], return_index=True, return_inverse=True)
            levels[level] = None  # as large as the sample: let each go in turn
            inverse = inverse.astype(np.int32)
            self.keys.append(keys)
            self.parent.append(np.zeros(len(keys), dtype=np.int64) if above is None else above[index])
            self.which.append(inverse[order])

    def log_odds(self, toxic: np.ndarray, use: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Posterior log-odds by level of the features that say something, learned from the texts in ``use``.

        The toxic share of a feature's contexts has a Dirichlet (two outcomes: beta) prior with PRIOR
        pseudo-contexts spread like its stem's posterior.  Features of a kept stem are kept too: they may take it back.
        """
        mine, label = use[self.text], toxic[self.text]
        base = (int((mine & (label > 0)).sum()) + 1) / (int(mine.sum()) + 2)  # never 0 or 1, even of one kind of text
        share, kept, out = np.full(1, base), np.zeros(1, dtype=bool), []
        for keys, parent, which in zip(self.keys, self.parent, self.which, strict=True):
            t = np.bincount(which[mine & (label > 0)], minlength=len(keys))
            c = np.bincount(which[mine & (label == 0)], minlength=len(keys))
            share = (t + PRIOR * share[parent]) / (t + c + PRIOR)
            lift = np.log(share / (1 - share)) - math.log(base / (1 - base))
            kept = (t + c > 0) & ((lift > LEAST_LOG_ODDS) | kept[parent])
            out.append((keys[kept], lift[kept]))
        return out


def fit(examples: list[tuple[str, int]]) -> Model:
    """A model from (text, 0 or 1) pairs; equal texts count once.  Deterministic."""
    labels: dict[str, int] = {}
    for text, toxic in examples:
        labels[text] = max(labels.get(text, 0), toxic)
    texts = sorted(labels)
    y = np.array([labels[t] for t in texts], dtype=np.int64)
    if not texts:
        return Model([(np.zeros(0, dtype=np.uint64), np.zeros(0))] * LEVELS)
    counts = Counts(texts)
    fold = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) >> 8 & 1 for t in texts], dtype=np.int64)
    rows = []
    for k in (0, 1):  # each half is scored by log-odds of the other
        model, own = Model(counts.log_odds(y, fold != k)), np.flatnonzero(fold == k)
        for lo in range(0, len(own), 512):
            part = own[lo : lo + 512]
            levels, first = tokens([texts[i] for i in part])
            values = model.token_scores(levels)
            for j, i in enumerate(part):
                scores = values[first[j] : first[j + 1]]
                rows.append((i, len(scores), model.segments(scores), scores))
    final = Model(counts.log_odds(y, np.ones(len(texts), dtype=bool)))
    final.rate, final.size = extreme_value([r for r in rows if y[r[0]] == 0], final.drift)
    x = np.array([final.inputs(r[2], r[1]) for r in rows])
    final.weights = logistic(x, y[[r[0] for r in rows]])
    return final


def extreme_value(clean: list[tuple], drift: float) -> tuple[float, float]:
    """(lambda, K): lambda is the positive root of E[exp(lambda * token score)] = 1 over the clean documents' tokens;
    K makes their best segments' mean normalised score Euler's constant, the mean of the standard law."""
    n = sum(r[1] for r in clean)
    hits = np.concatenate([r[3][r[3] != 0] for r in clean]) if clean else np.zeros(0)
    if not n or not (hits > drift).any():
        return 1.0, 1.0 / max(1, n)
    mean_exp = lambda r: (math.exp(-r * drift) * (n - len(hits)) + np.exp(r * (hits - drift)).sum()) / n
    lo, hi = 1e-6, 1.0
    while mean_exp(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean_exp(mid) < 1 else (lo, mid)
    best = [(max((s for _, _, s in r[2]), default=0.0), r[1]) for r in clean if r[1]]
    offset = float(np.mean([lo * s - math.log(k) for s, k in best])) - 0.5772156649
    return lo, min(1.0, math.exp(offset))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Intercept and slopes by Newton's method; slopes shrink a little, so that separable data stay finite."""
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(a.shape[1]), np.diag([0.0, *[ridge] * x.shape[1]])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.lstsq(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + penalty, a.T @ (y - p) - penalty @ w, rcond=None)[0]
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """A model from labelled rows outside the held-out fifth: at most ``max_rows``, chosen by a hash of their id, and of them, in
    that order, those whose whole texts fit together into ``max_bytes``.

    Ids with several labels take the highest; of rows that repeat an id one text is learned from; null labels and ids teach nothing.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    marked = marked.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
    # The hash leaves about four times the ids needed, however many there are; then the smallest hashes are taken.
    share = min(1.0, 4 * max_rows / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    marked = marked.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    text = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = text.join(F.broadcast(marked), "_id")  # max_rows rows
    kind = F.struct(F.xxhash64("_text"), F.octet_length("_text"))
    sizes = rows.groupBy("_id").agg(F.max("_toxic").alias("_toxic"), F.min(F.struct(kind.alias("k"), F.octet_length("_text").alias("n"))).alias("m"))
    chosen, room = [], max_bytes
    for r in sizes.orderBy(F.xxhash64("_id"), "_id").collect():  # max_rows rows, no texts
        if r["m"]["n"] <= room:
            room -= r["m"]["n"]
            chosen.append((r["_id"], r["m"]["k"][0], r["m"]["n"], r["_toxic"]))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "_id long, _hash long, _size int, _toxic int"))
    found = text.withColumn("_hash", F.xxhash64("_text")).withColumn("_size", F.octet_length("_text")).join(wanted, ["_id", "_hash", "_size"])
    # Equal rows are one by now.  The scan runs in parallel; what it found comes over in eighths.
    found = found.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_toxic").alias("_toxic"))
    return fit([(r["_text"], int(r["_toxic"] > 0)) for r in found.repartition(8).toLocalIterator()])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, segments.

    ``segments``: the significant passages as (first token, tokens, score).  Null or empty text has the
    score of a text without tokens.  Repeated rows each get a row; an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("first_token", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            got = shared.value.score(batch.column(2).to_pylist())
            found = [[{"first_token": a, "n_tokens": b - a + 1, "score": s} for a, b, s in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= 0.5) for g in got], pa.int32()), pa.array(found, pa.list_(passage))],
                names=["doc_id", "held_out", "score", "predicted", "segments"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    schema = "doc_id long, held_out boolean, score double, predicted int, segments array<struct<first_token:long,n_tokens:long,score:double>>"
    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns stay, nothing is shuffled."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = [s < threshold for s, _ in shared.value.score(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
