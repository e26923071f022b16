"""Pairs of texts whose token sets may be as near as a threshold, for whole blocks: subsequences by bits, many pairs at once.

Of a pair only what differs is aligned, as :func:`millrace.functions.udfs.token_set_ratio` does. A pair that reaches the threshold leaves few characters of
either side alone, so its alignment keeps near the diagonal: matches away from it are left out, and a pair ends when too much is lost.
Characters are told apart by CODES places only. Both may only let pairs through that miss the threshold, never the other way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs that are aligned at once; steps after which those that can't reach it any more are left out; places for characters; characters of a text from which it isn't aligned here.
PAIRS, STEPS, CODES, LONG = 4096, 16, 64, 2048
_ONE, _WORD = np.uint64(1), 64


def _within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges that begin at ``starts``: the range of each element, and the element."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _parts(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct tokens of a text in order, the characters of each with a space after it, and their tokens' numbers."""
    tokens = sorted(set(text.split()))
    chars = np.frombuffer("".join(f"{t} " for t in tokens).encode("utf-32-le", "surrogatepass"), np.uint32) % CODES
    return tokens, chars.astype(np.uint8), np.repeat(np.arange(len(tokens)), [len(t) + 1 for t in tokens])


class TokenSets:
    """The texts of a block, and pairs with them that wait to be aligned."""

    def __init__(self, texts: list[str], threshold: float):
        self.threshold, self.number = threshold, {}
        found = [_parts(t) for t in texts]
        ids = [np.array([self.number.setdefault(t, len(self.number)) for t in tokens], np.int64) for tokens, _, _ in found]
        ends = lambda parts: np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.token_at, self.char_at = ends(ids), ends([c for _, c, _ in found])
        self.tokens = np.concatenate([*ids, np.zeros(0, np.int64)])
        self.chars = np.concatenate([*(c for _, c, _ in found), np.zeros(0, np.uint8)])
        self.char_token = np.concatenate([np.zeros(0, np.int64), *(own + at for (_, _, own), at in zip(found, self.token_at[:-1], strict=True))])
        self.sizes = np.zeros(len(self.tokens), np.int64)
        np.add.at(self.sizes, self.char_token, 1)
        self.place, self.common = np.full(len(self.number), -1), np.zeros(len(self.tokens), bool)
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, key: int, text: str, on: np.ndarray) -> Iterator[tuple[int, int]]:
        """Put the pairs of a key with the texts ``on``; gives (text, key) of pairs of this and earlier keys that may reach the threshold."""
        tokens, chars, own = _parts(text)
        size = np.diff(self.char_at)[on]
        long = (size > LONG) | (len(chars) > LONG)
        yield from ((int(i), key) for i in on[long])
        on, size = on[~long], size[~long]
        if not len(on) or not len(chars):
            return
        ids = np.array([self.number.get(t, -1) for t in tokens])
        known = np.flatnonzero(ids >= 0)
        self.place[ids[known]] = known
        row, at = _within(self.token_at[on], np.diff(self.token_at)[on])
        place = self.place[self.tokens[at]]
        self.place[ids[known]] = -1
        both = place >= 0
        shared = np.bincount(row[both], self.sizes[at[both]], len(on)).astype(np.int64)  # a space after each token
        n, m, c, s = size - 1, len(chars) - 1, np.maximum(shared - 1, 0), (shared > 0).astype(np.int64)
        # Both sides end with a space, which adds one to what they have in common.
        need = np.ceil(self.threshold * (n + m) / 200 - c - s + 1 - 1e-6).astype(np.int64)
        left, right = size - shared, len(chars) - shared
        sure = (left == 0) | (right == 0) | (200.0 * c >= self.threshold * (c + np.minimum(n, m)) - 1e-6) & (shared > 0)
        yield from ((int(i), key) for i in on[sure])
        use = ~sure & (np.minimum(left, right) >= need)
        if not use.any():
            return
        rows = np.flatnonzero(use)
        common = np.zeros((len(on), len(tokens)), bool)
        common[row[both], place[both]] = True
        theirs = np.broadcast_to(chars, (len(rows), len(chars)))[~common[rows][:, own]]
        self.common[at[both]] = True
        e = _within(self.char_at[on[rows]], size[rows])[1]
        mine = self.chars[e[~self.common[self.char_token[e]]]]
        self.common[at[both]] = False
        self.waiting.append((on[rows], np.full(len(rows), key), mine, left[rows], theirs, right[rows], need[rows]))
        self.held += len(rows)
        if self.held >= PAIRS:
            yield from self.rest()

    def rest(self) -> Iterator[tuple[int, int]]:
        """(text, key) of the pairs that wait and may reach the threshold."""
        if not self.waiting:
            return
        texts, keys, a, m, b, n, need = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.held = [], 0
        a_at, b_at = np.cumsum(m) - m, np.cumsum(n) - n
        order = np.argsort(np.maximum(m, n), kind="stable")
        for p in np.array_split(order, max(1, round(len(order) / PAIRS))):
            on = p[_aligned(a, a_at[p], m[p], b, b_at[p], n[p], need[p])]
            yield from zip(texts[on].tolist(), keys[on].tolist(), strict=True)


def _aligned(a: np.ndarray, a_at: np.ndarray, m: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Numbers of the pairs whose common subsequence may have ``need`` characters; the sides are ``m`` characters of ``a`` and ``n`` of ``b``."""
    words = -(-int(m.max()) // _WORD)
    match: list[np.ndarray] = []
    number, every = np.arange(len(m)), len(m) * (CODES + 1)  # the last place of a pair is that of no character
    base, v = number * (CODES + 1), np.full((words, len(m)), ~np.uint64(0))
    # At most so many characters of either side are left alone: beyond the place of the other by more, nothing is matched.
    ahead, behind, j, last = m - need, n - need, 0, int(n.max())
    out = []
    while len(number):
        # Sides that have ended give no more matches, and are taken out at the next check.
        code = base + np.where(j < n, b[np.minimum(b_at + j, len(b) - 1)], CODES)
        low, high = max(0, (j - int(behind.max())) // _WORD), min(words - 1, (j + int(ahead.max())) // _WORD)
        while len(match) <= high:  # made when the diagonal comes near, for the pairs that are left
            match.append(np.zeros(every, np.uint64))
            for i in range(_WORD):
                at = np.flatnonzero(m > i + _WORD * (len(match) - 1))
                match[-1][base[at] + a[a_at[at] + i + _WORD * (len(match) - 1)]] |= _ONE << np.uint64(i)
        carry = np.zeros(len(number), np.uint64)
        for w in range(low, high + 1):
            x = v[w]
            u = x & match[w].take(code)
            total = x + u
            over = total < x
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            v[w] = total | (x ^ u)
        j += 1
        if j % STEPS == 0 or j >= last:
            # Zeros are the subsequence so far; bits above a side's end never match.
            common = np.bitwise_count(~v).sum(0, dtype=np.int64)
            done = j >= n
            out.append(number[done & (common >= need)])
            keep = ~done & (common + n - j >= need)
            if not keep.all():
                number, base, v = number[keep], base[keep], v[:, keep]
                a_at, m, b_at, n, need, ahead, behind = (x[keep] for x in (a_at, m, b_at, n, need, ahead, behind))
    return np.concatenate([*out, np.zeros(0, np.int64)])
