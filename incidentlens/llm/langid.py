"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time.  It reads
windows of ``WINDOW`` bytes in both directions and labels every byte; a document's
probabilities are the means over the bytes of its words, over the whole text.  Training
takes a bounded number of slices per language (``PER_LANGUAGE`` of ``SLICE`` characters,
from pseudorandom documents and places); prediction runs on executors with the broadcast
weights, which don't depend on the data's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN, WINDOW, BATCH, STEPS, RATE = 8, 64, 128, 240, 0.02
PER_LANGUAGE, SLICE, SEED = 300, 2000, 11
#: Windows that run through the network together; bounds the memory of a task.
TOGETHER = 2048

#: Bytes that belong to words: letters, and everything beyond ASCII.
_WORDY = np.zeros(256, dtype=bool)
_WORDY[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1.0
    np.multiply(x, 0.5, out=x)
    return x


class Network:
    """Parameters by name: per direction d in "fb" an input table ``Wd`` (256, 3H), recurrent ``Ud`` (H, 3H)
    and candidate bias ``cd`` (H,); output ``V`` (2H, K) and ``c`` (K,).  Gates go update, reset, candidate."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.classes, self.hidden = classes, hidden
        self.p = {"V": draw(2 * hidden, len(classes), scale=0.3), "c": np.zeros(len(classes), dtype=np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(256, 3 * hidden, scale=0.3), f"U{d}": draw(hidden, 3 * hidden, scale=0.3), f"c{d}": np.zeros(hidden, dtype=np.float32)}

    def run(self, d: str, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States (T, B, H) of one direction over bytes x (T, B)."""
        h2, n = 2 * self.hidden, x.shape[0]
        W, U, c = self.p[f"W{d}"], self.p[f"U{d}"], self.p[f"c{d}"]
        out = np.empty((n, x.shape[1], self.hidden), dtype=np.float32)
        h = np.zeros((x.shape[1], self.hidden), dtype=np.float32)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            a = W[x[t]]
            u = h @ U
            gates = _sigmoid(a[:, :h2] + u[:, :h2])
            z, r = gates[:, : self.hidden], gates[:, self.hidden :]
            inner = u[:, h2:] + c
            cand = np.tanh(a[:, h2:] + r * inner)
            if tape is not None:
                tape.append((t, h, z, r, inner, cand))
            h = out[t] = cand + z * (h - cand)
        return out

    def back(self, d: str, x: np.ndarray, tape: list, grad: np.ndarray, into: dict[str, np.ndarray]) -> None:
        """Backpropagation through time: grad (T, B, H) of the states into the parameters' gradients."""
        h2, U = 2 * self.hidden, self.p[f"U{d}"]
        dW, dU, dc = into[f"W{d}"], into[f"U{d}"], into[f"c{d}"]
        carry = np.zeros_like(grad[0])
        inputs, at = [], []
        for t, h, z, r, inner, cand in reversed(tape):
            g = grad[t] + carry
            dcand = g * (1 - z) * (1 - cand * cand)
            dz = g * (h - cand) * z * (1 - z)
            dinner = dcand * r
            dr = dcand * inner * r * (1 - r)
            du = np.concatenate([dz, dr, dinner], axis=1)
            dU += h.T @ du
            dc += dinner.sum(axis=0)
            carry = g * z + du @ U.T
            inputs.append(np.concatenate([dz, dr, dcand], axis=1))
            at.append(x[t])
        at, inputs = np.concatenate(at), np.concatenate(inputs)
        order = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[order], prepend=-1))
        dW[at[order][edges]] += np.add.reduceat(inputs[order], edges, axis=0)

    def logits(self, x: np.ndarray, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        states = np.concatenate([self.run(d, x, None if tapes is None else tapes[i]) for i, d in enumerate("fb")], axis=2)
        return states @ self.p["V"] + self.p["c"], states

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, K, B): every position's label probabilities for bytes x (T, B); the batch is the fast axis throughout."""
        n, b, hid = x.shape[0], x.shape[1], self.hidden
        y = np.empty((n, len(self.classes), b), dtype=np.float32)
        y[:] = self.p["c"][:, None]
        for i, d in enumerate("fb"):
            W, U, c = np.ascontiguousarray(self.p[f"W{d}"].T), np.ascontiguousarray(self.p[f"U{d}"].T), self.p[f"c{d}"][:, None]
            V = np.ascontiguousarray(self.p["V"][i * hid : (i + 1) * hid].T)
            h, a, u = np.zeros((hid, b), dtype=np.float32), np.empty((3 * hid, b), dtype=np.float32), np.empty((3 * hid, b), dtype=np.float32)
            for t in range(n) if d == "f" else range(n - 1, -1, -1):
                np.take(W, x[t], axis=1, out=a, mode="clip")
                np.matmul(U, h, out=u)
                u[2 * hid :] += c
                gates = a[: 2 * hid]
                gates += u[: 2 * hid]
                _sigmoid(gates)
                cand = u[2 * hid :]
                cand *= gates[hid:]
                cand += a[2 * hid :]
                np.tanh(cand, out=cand)
                h -= cand
                h *= gates[:hid]
                h += cand
                y[t] += V @ h
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the word bytes of windows x (T, B) with one label each, and its gradients."""
        tapes: tuple[list, list] = ([], [])
        y, states = self.logits(x, tapes)
        y -= y.max(axis=2, keepdims=True)
        p = np.exp(y)
        p /= p.sum(axis=2, keepdims=True)
        use = _WORDY[x]
        total = max(1, int(use.sum()))
        own = np.broadcast_to(label, x.shape)
        picked = np.take_along_axis(p, own[..., None], axis=2)[..., 0]
        loss = float(-(np.log(np.maximum(picked, 1e-12)) * use).sum() / total)
        np.put_along_axis(p, own[..., None], picked[..., None] - 1, axis=2)
        p *= (use / np.float32(total))[..., None].astype(p.dtype)
        into = {k: np.zeros_like(v) for k, v in self.p.items()}
        into["V"][:] = states.reshape(-1, states.shape[2]).T @ p.reshape(-1, p.shape[2])
        into["c"][:] = p.sum(axis=(0, 1))
        back = p @ self.p["V"].T
        for i, d in enumerate("fb"):
            self.back(d, x, tapes[i], back[..., i * self.hidden : (i + 1) * self.hidden], into)
        return loss, into


def windows_of(data: bytes, size: int = WINDOW) -> np.ndarray:
    """(n, size) bytes; the last window is filled up with zero bytes."""
    return np.frombuffer(data + bytes(-len(data) % size), dtype=np.uint8).reshape(-1, size)


def train(examples: list[tuple[str, str]], *, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network:
    """A network from (text, language) pairs; deterministic.  Batches draw languages evenly."""
    classes = sorted({lang for _, lang in examples})
    net, rng = Network(classes, seed=seed), np.random.default_rng(seed)
    pools = []
    for k in classes:
        own = [windows_of(t.encode("utf-8", "surrogatepass")) for t, lang in sorted(examples) if lang == k and t]
        pools.append(np.concatenate(own) if own else np.zeros((1, WINDOW), dtype=np.uint8))
    if len(classes) < 2:
        return net
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        label = rng.integers(0, len(classes), batch)
        x = np.stack([pools[k][rng.integers(0, len(pools[k]))] for k in label], axis=1)
        _, grads = net.gradients(x, label)
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))
        now = rate * min(1.0, (steps - step + 1) / (0.4 * steps))
        for k, g in grads.items():  # Adam
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(net: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, its pooled probability) of whole texts; ("und", 0.0) without letters."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    pooled, weight = np.zeros((len(texts), len(net.classes))), np.zeros(len(texts))
    rows, owners, held = [], [], 0

    def flush() -> None:
        nonlocal rows, owners, held
        if not rows:
            return
        x, owner = np.concatenate(rows), np.repeat([o for o, _ in owners], [n for _, n in owners])
        for lo in range(0, len(x), TOGETHER):
            part, own = x[lo : lo + TOGETHER].T, owner[lo : lo + TOGETHER]
            use = _WORDY[part].astype(np.float32)
            p = np.einsum("tkb,tb->bk", net.probabilities(np.ascontiguousarray(part)), use)
            np.add.at(pooled, own, p)
            np.add.at(weight, own, use.sum(axis=0))
        rows, owners, held = [], [], 0

    for i, text in enumerate(texts):
        if text and has_letter(text):
            data = windows_of(text.encode("utf-8", "surrogatepass"))
            rows.append(data)
            owners.append((i, len(data)))
            held += len(data)
            if held >= 8 * TOGETHER:
                flush()
    flush()
    for i in np.flatnonzero(weight):
        share = pooled[i] / weight[i]
        k = int(np.argmax(share))
        out[i] = (net.classes[k], float(min(1.0, max(0.0, share[k]))))
    return out


def held_out(id_col: str) -> Column:
    """Whether a row takes no part in learning: crc32 of its id's digits divides by 5.  A null id counts as no digits."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, slice_chars: int) -> DataFrame:
    """At most ``per_language`` slices a language, of training rows chosen by a hash of id and text."""
    own = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0))
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    # A row per language: its distinct rows with text, for the hash passes all equal rows or none.
    counts = {r[0]: r[1] for r in own.groupBy(lang_col).agg(F.approx_count_distinct(key)).collect()}
    # A hash leaves about four times what a language needs, however many rows it has; then the smallest hashes are taken.
    share = F.lit(1.0)
    for lang, n in counts.items():
        if n > 4 * per_language:
            share = F.when(F.col(lang_col) == lang, F.lit(4 * per_language / n)).otherwise(share)
    rows = own.where(F.pmod(key, F.lit(1 << 30)) < share * (1 << 30))
    place = F.pmod(key, F.greatest(F.lit(1), F.length(text_col) - slice_chars)) + 1
    cut = rows.select(F.col(lang_col).alias("lang"), key.alias("key"), F.col(text_col).substr(place.cast("int"), F.lit(slice_chars)).alias("piece"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("key", "piece"))  # limited per task before the shuffle
    return cut.withColumn("n", first).where(F.col("n") <= per_language).select("piece", "lang")


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_language: int = PER_LANGUAGE, slice_chars: int = SLICE,
) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Null text, or one without a letter: ``und`` with score 0.  Without any training row, every text is
    ``und``; with one language only, that one.  Repeated rows each get a row; an empty table none.
    """
    examples = [tuple(r) for r in sample(docs, id_col, text_col, lang_col, per_language, slice_chars).collect()]
    net = train(examples)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            got = predict(shared.value, texts) if shared.value.classes else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
