"""Targets and weights over plain dictionaries, for comparison."""

MAX_REPEATS = 3


def targets(sizes: dict, weights: dict, cap: float = MAX_REPEATS) -> dict:
    """Shares ``sum(sizes)`` by weight; no target passes ``cap`` times its size, and what it can't take is reshared."""
    out, open_, left = {s: 0.0 for s in sizes}, set(sizes), float(sum(sizes.values()))
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total >= cap * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def cyclic_weights(sources: list) -> dict:
    """1, 2, 3, repeating, over sources in code point order with null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)
    return {s: 1 + i % 3 for i, s in enumerate(ordered)}
