"""Pairs of near texts by edit distance, for whole blocks: counts of characters first, then distances by bits, many pairs at once.

The distance is Myers's (1999): a column of the table is two numbers of bits, those of a step up and those of a step down, and a character of
the other text moves all bits together. Here each number is an array with an element for each pair.
"""

from __future__ import annotations

import numpy as np

#: Pairs that are measured at once; steps after which pairs that can't be near any more are left out; places for counts of characters.
PAIRS, STEPS, CHARS = 8192, 48, 64
_ONE, _TOP, _WORD = np.uint64(1), np.uint64(63), 64


def _coded(left: list[str], right: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """The texts as small numbers, the same for the same character, and how many there are."""
    texts = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (*left, *right)]
    kinds, codes = np.unique(np.concatenate(texts), return_inverse=True)
    parts = np.split(codes.astype(np.int64), np.cumsum([len(t) for t in texts])[:-1])
    return parts[: len(left)], parts[len(left) :], len(kinds)


def _table(texts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(texts), max(map(len, texts))), np.int64)
    for i, t in enumerate(texts):
        out[i, : len(t)] = t
    return out


def _counts(texts: list[np.ndarray]) -> np.ndarray:
    return np.minimum(np.stack([np.bincount(t % CHARS, minlength=CHARS) for t in texts]), (1 << 14) - 1).astype(np.int16)


def _still(up: np.ndarray, down: np.ndarray, j: int, m: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether, after ``j`` characters, a way to the end within ``most`` is left: the distance so far and the difference of what remains, at any place."""
    bits = lambda x: np.unpackbits(np.ascontiguousarray(x.T).astype("<u8").view(np.uint8), axis=1, bitorder="little").view(np.int8)
    so_far = np.cumsum(bits(up) - bits(down), axis=1, dtype=np.int32) + j
    i = np.arange(1, so_far.shape[1] + 1, dtype=np.int32)[None, :]
    rest = np.abs((m - n + j)[:, None].astype(np.int32) - i)
    least = np.where(i <= m[:, None], so_far + rest, 1 << 30).min(1)
    return np.minimum(least, j + np.abs(m - n + j)) <= most


def _measured(patterns: list[np.ndarray], table: np.ndarray, kinds: int, p: np.ndarray, t: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of pairs (pattern p, row t of the table with n characters), whether the distance is at most ``most``; no text is empty."""
    own, p = np.unique(p, return_inverse=True)
    m = np.array([len(patterns[i]) for i in own])
    words = -(-int(m.max()) // _WORD)
    match = np.zeros((words, len(own) * kinds), np.uint64)
    for k, i in enumerate(own):
        place = np.arange(m[k])
        np.bitwise_or.at(match, (place // _WORD, k * kinds + patterns[i]), _ONE << (place % _WORD).astype(np.uint64))
    out = np.zeros(len(p), bool)
    at = np.argsort(n, kind="stable")  # the pairs that are left, by the length of the text
    n, most, base, rows, m = n[at], most[at], p[at] * kinds, t[at], m[p[at]]
    up, down = np.full((words, len(at)), ~np.uint64(0)), np.zeros((words, len(at)), np.uint64)
    inside = np.clip(m[None, :] - _WORD * np.arange(words)[:, None], 0, _WORD)
    mask = np.where(inside == _WORD, ~np.uint64(0), (_ONE << np.minimum(inside, _WORD - 1).astype(np.uint64)) - _ONE)
    j = 0
    while len(at):
        place = base + table[rows, j]
        more, less = np.ones(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for w in range(words):
            eq, u, d = match[w].take(place), up[w], down[w]
            x = eq | d
            eq |= less
            h = (((eq & u) + u) ^ u) | eq
            plus, minus = d | ~(h | u), u & h
            over, under = plus >> _TOP, minus >> _TOP
            plus, minus = plus << _ONE | more, minus << _ONE | less
            up[w], down[w] = minus | ~(x | plus), plus & x
            more, less = over, under
        j += 1
        ended = int(np.searchsorted(n, j, "right"))
        if ended:
            bits = lambda x: np.bitwise_count(x[:, :ended] & mask[:, :ended]).sum(0).astype(np.int64)  # noqa: B023, E731
            out[at[:ended]] = j + bits(up) - bits(down) <= most[:ended]
        keep = np.arange(len(at)) >= ended
        if j % STEPS == 0:
            keep[ended:] &= _still(up[:, ended:], down[:, ended:], j, m[ended:], n[ended:], most[ended:])
        if not keep.all():
            at, n, most, base, rows, m, up, down, mask = at[keep], n[keep], most[keep], base[keep], rows[keep], m[keep], up[:, keep], down[:, keep], mask[:, keep]
    return out


def near_pairs(left: list[str], right: list[str], longer: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a left and a right text, none empty, whose edit distance is at most ``share`` of ``longer`` (by left and right text); exact."""
    one, two, kinds = _coded(left, right)
    m, n, a, b, table = np.array([len(t) for t in one]), np.array([len(t) for t in two]), _counts(one), _counts(two), _table(two)
    most = np.floor(share * longer + 1e-9).astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def measure() -> None:
        p, t = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        for i in range(0, len(p), PAIRS):
            q, r = p[i : i + PAIRS], t[i : i + PAIRS]
            on = _measured(one, table, kinds, q, r, n[r], most[q, r])
            found.append((q[on], r[on]))

    held = 0
    for i in range(len(one)):
        # Each edit takes away one character and brings one at most.
        r = np.flatnonzero(np.abs(n - m[i]) <= most[i])
        r = r[np.abs(b[r] - a[i]).sum(1, dtype=np.int32) + np.abs(n[r] - m[i]) <= 2 * most[i, r]]
        waiting.append((np.full(len(r), i), r))
        held += len(r)
        if held >= PAIRS:
            measure()
            held = 0
    if waiting:
        measure()
    return np.concatenate([q for q, _ in found] or [np.zeros(0, np.int64)]), np.concatenate([r for _, r in found] or [np.zeros(0, np.int64)])
