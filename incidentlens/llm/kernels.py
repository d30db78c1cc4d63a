"""Vectorised text kernels shared by the corpus operators.

Everything here is plain numpy over byte buffers, runs inside Arrow batches on
the executors and is deterministic: no process-level hash seeds are used.

A *word* is a maximal run of bytes outside ``0x20, 0x09-0x0D``; lower-casing
touches ``A-Z`` only.  Texts are handled whole: long ones are walked in pieces
that end at white space, so memory is bounded by ``PIECE`` bytes plus one word.
"""

from __future__ import annotations

import hashlib

import numpy as np

PIECE = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    got = _powers.get(kind)
    if got is None or len(got) < n:
        size = max(n, PIECE * 2)
        steps = np.full(size, base, dtype=_U)
        steps[0] = 1
        got = _powers[kind] = np.multiply.accumulate(steps)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection), so that low-entropy inputs spread over all bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z folded; null is empty.  Lone surrogates cannot occur in Spark strings."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def _pieces(data: bytes, limit: int) -> list[bytes]:
    """Cuts at white space into pieces of about ``limit`` bytes; a longer word stays whole."""
    if len(data) <= limit:
        return [data]
    view, out, at = np.frombuffer(data, dtype=np.uint8), [], 0
    while len(data) - at > limit:
        gaps = np.flatnonzero(_SPACE[view[at + limit : at + 2 * limit]])
        end = at + limit + int(gaps[0]) if len(gaps) else len(data)
        if not len(gaps):
            for lo in range(at + 2 * limit, len(data), limit):
                gaps = np.flatnonzero(_SPACE[view[lo : lo + limit]])
                if len(gaps):
                    end = lo + int(gaps[0])
                    break
        out.append(data[at:end])
        at = end
    out.append(data[at:])
    return out


def spans(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``inside`` holds."""
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent polynomial hashes of the given byte runs, finalised."""
    if not len(starts):
        return np.zeros(0, dtype=_U)
    n = len(buf)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum((buf.astype(_U) + _U(1)) * _power("up", _BASE, n), out=total[1:])
    raw = (total[ends] - total[starts]) * _power("down", _BASE_INV, n)[starts]
    return mix(raw + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def word_hashes(docs: list[bytes], inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every document, first word of each document plus the total)."""
    keep = ~_SPACE if inside is None else inside
    parts, counts, batch, size = [], np.zeros(len(docs), dtype=np.int64), [], 0

    def flush() -> None:
        nonlocal batch, size
        if batch:
            joined = b" ".join(d for _, d in batch)
            buf = np.frombuffer(joined, dtype=np.uint8)
            starts, ends = spans(buf, keep[buf])
            parts.append(span_hashes(buf, starts, ends))
            edges = np.cumsum([0] + [len(d) + 1 for _, d in batch])
            per = np.diff(np.searchsorted(starts, edges))
            np.add.at(counts, [i for i, _ in batch], per)
        batch, size = [], 0

    for i, data in enumerate(docs):
        for piece in _pieces(data, PIECE):
            batch.append((i, piece))
            size += len(piece) + 1
            if size >= PIECE:
                flush()
    flush()
    first = np.concatenate([[0], np.cumsum(counts)])
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=_U)), first


_STEP = [pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) for k in range(64)]


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (order matters)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    total = np.zeros(n, dtype=_U)
    for j in range(k):
        total += words[j : j + n] * _U(_STEP[j])
    return mix(total)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles; a sequence shorter than ``k`` is one shingle, none has none."""
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(k, len(words))))


def set_key(shingle_set: np.ndarray) -> bytes:
    """128-bit digest of a sorted shingle set."""
    return hashlib.blake2b(shingle_set.astype("<u8").tobytes(), digest_size=16).digest()
