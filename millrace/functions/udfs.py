"""Arrow functions for what has no form in built-in functions: token-set similarity, ROUGE-L and a hashing encoder."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from millrace.storage import small_batches

ColumnOrName = Column | str


def _common(a: list | str, b: list | str, least: float = 0) -> int:
    """Length of the longest common subsequence, by bits: one step for each element of b. Ends early, with a smaller number, where ``least`` is out of reach."""
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for j, x in enumerate(b, 1):
        u = v & place.get(x, 0)
        v = (v + u | v - u) & full
        if not j % 16 and len(a) - v.bit_count() + len(b) - j < least:
            break
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * twice the common subsequence over both lengths; 100 for two empty texts."""
    n = len(a) + len(b)
    return 100.0 * 2 * _common(a, b) / n if n else 100.0


def token_set_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Similarity of token sets: the common tokens against each side, and the sides against each other; the best counts.

    Both sides begin with the common tokens, so only what differs is aligned. A score below ``least`` may come out lower.
    """
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = x & y, x - y, y - x
    if both and (not left or not right):
        return 100.0
    size = lambda tokens: sum(map(len, tokens)) + max(0, len(tokens) - 1)
    common = size(both)
    space = 1 if both else 0
    n, m = common + space + size(left), common + space + size(right)
    best = max(200.0 * common / (common + n), 200.0 * common / (common + m)) if both else 0.0
    need = max(best, least) * (n + m) / 200.0 - common - space
    if min(n, m) - common - space >= need:  # the most that the sides can have in common
        best = max(best, 200.0 * (common + space + _common(" ".join(sorted(left)), " ".join(sorted(right)), need - 1e-6)) / (n + m))
    return best


def _on_pairs(score: Callable[[str, str], float]) -> Callable[[ColumnOrName, ColumnOrName], Column]:
    """A column function from a score of two texts; the Arrow function is made when it is used, for workers import this module without a session."""

    def apply(a: ColumnOrName, b: ColumnOrName) -> Column:
        small_batches(SparkSession.active())

        @F.pandas_udf("double")
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([score(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype=float)

        return run(a, b)

    return apply


def common_tokens_ratio(a: str, b: str) -> float:
    """The part of :func:`token_set_ratio` that common tokens give; nothing is aligned."""
    return token_set_ratio(a, b, 200.0)  # more than any alignment gives


token_set_ratio_udf, common_tokens_ratio_udf = _on_pairs(token_set_ratio), _on_pairs(common_tokens_ratio)


def _measure(stem: str) -> int:
    """How often a run of vowels is followed by consonants."""
    kinds = "".join("v" if c in "aeiou" or c == "y" and i and stem[i - 1] not in "aeiou" else "c" for i, c in enumerate(stem))
    return len(re.findall("v+c+", kinds))


def _has_vowel(stem: str) -> bool:
    return any(c in "aeiou" or c == "y" and i and stem[i - 1] not in "aeiou" for i, c in enumerate(stem))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x and y."""
    if len(stem) < 3:
        return False
    c, v, d = stem[-3], stem[-2], stem[-1]
    vowel = lambda x, before: x in "aeiou" or x == "y" and before not in "aeiou"
    return c not in "aeiou" and vowel(v, c) and d not in "aeiouwxy"


#: Suffixes of the second, third and fourth step of Porter's stemmer (1980).
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def stem(word: str) -> str:
    """Porter's stemmer as published."""
    w = word
    if len(w) <= 2:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: len(w) - len(end)]) > 0:
                    w = w[: len(w) - len(end)] + new
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def rouge_l(prediction: str, reference: str, stemming: bool = True) -> float:
    """F1 of the longest common subsequence of lower-case alphanumeric tokens; longer ones are stemmed."""
    a, b = (re.findall("[a-z0-9]+", x.lower()) for x in (prediction or "", reference or ""))
    if not a or not b:
        return 0.0
    if stemming:
        a, b = ([stem(w) if len(w) > 3 else w for w in x] for x in (a, b))
    common = _common(a, b)
    if not common:
        return 0.0
    p, r = common / len(a), common / len(b)
    return 2 * p * r / (p + r)


def rouge_l_plain(prediction: str, reference: str) -> float:
    """Without stemming."""
    return rouge_l(prediction, reference, stemming=False)


rouge_l_udf, rouge_l_plain_udf = _on_pairs(rouge_l), _on_pairs(rouge_l_plain)


def hashed_vector(text: str, dim: int = 64) -> np.ndarray:
    """A unit vector of signed hashed tokens: the offline stand-in for an encoder model."""
    v = np.zeros(dim)
    for token in re.findall(r"\w+", (text or "").lower()):
        h = zlib.crc32(token.encode())
        v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
    n = np.linalg.norm(v)
    return v / n if n else v


@lru_cache(1 << 18)
def _term_place(term: str) -> tuple[int, float]:
    h = hashlib.md5(term.encode()).hexdigest()
    return int(h[:2], 16), 1.0 if int(h[2], 16) >= 8 else -1.0


def hashed_terms(tokens: ColumnOrName, dim: int = 64) -> Column:
    """Unit vectors of signed terms, hashed by MD5 as any engine can: the offline stand-in for an encoder of texts. ``dim`` divides 256; no term gives zeros."""
    small_batches(SparkSession.active())

    @F.pandas_udf("array<double>")
    def run(lists: pd.Series) -> pd.Series:
        out = []
        for terms in lists:
            v = np.zeros(dim)
            for t in terms if terms is not None else ():
                place, sign = _term_place(t)
                v[place % dim] += sign
            n = np.sqrt((v * v).sum())
            out.append(v / n if n else v)
        return pd.Series(out, dtype=object)

    return run(tokens)


def hashed_vectors(text: ColumnOrName) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashed_vector(t).astype(np.float32))

    return run(text)


def greedy_match_f1(a: np.ndarray, b: np.ndarray) -> float:
    """F1 of greedy matching by largest cosine between two sets of token vectors."""
    if not len(a) or not len(b):
        return 0.0
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = norm(a) @ norm(b).T
    p, r = s.max(1).mean(), s.max(0).mean()
    return float(2 * p * r / (p + r)) if p + r > 0 else 0.0


TokenVectors = Callable[[list[str]], Sequence[np.ndarray]]
#: Pairs whose vectors are multiplied at once; pairs whose vectors are held at once.
_MATCH_BLOCK, _MATCH_HELD = 32, 64


def greedy_match_block(left: Sequence[np.ndarray], right: Sequence[np.ndarray]) -> np.ndarray:
    """:func:`greedy_match_f1` of many pairs: one product of padded matrices for each block of pairs of near sizes."""
    out = np.zeros(len(left))
    size = np.array([len(a) * len(b) for a, b in zip(left, right, strict=True)])
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]

    def padded(which: np.ndarray, of: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(of[i]) for i in which])
        m = np.zeros((len(which), n.max(), of[which[0]].shape[1]))
        for k, i in enumerate(which):
            m[k, : n[k]] = of[i]
        return m / np.maximum(np.linalg.norm(m, axis=2, keepdims=True), 1e-12), n

    for i in range(0, len(order), _MATCH_BLOCK):
        which = order[i : i + _MATCH_BLOCK]
        (a, n), (b, m) = padded(which, left), padded(which, right)
        s = a @ b.transpose(0, 2, 1)
        real = (np.arange(a.shape[1])[None, :, None] < n[:, None, None]) & (np.arange(b.shape[1])[None, None, :] < m[:, None, None])
        s = np.where(real, s, -np.inf)
        best = lambda x, axis, count: np.where(np.isfinite(x.max(axis)), x.max(axis), 0.0).sum(1) / count
        p, r = best(s, 2, n), best(s, 1, m)
        out[which] = np.where(p + r > 0, 2 * p * r / np.where(p + r > 0, p + r, 1.0), 0.0)
    return out


@lru_cache(1 << 14)
def _trigrams(token: str) -> np.ndarray:
    return hashed_vector(" ".join(f"^{token}$"[i : i + 3] for i in range(len(token))), 128)


def trigram_vectors(texts: list[str]) -> list[np.ndarray]:
    """Hashed character trigrams of each token: the offline stand-in for a model's token vectors."""
    split = [(t or " ").lower().split() for t in texts]
    return [np.stack([_trigrams(t) for t in tokens]) if tokens else np.zeros((0, 128)) for tokens in split]


def token_match(provider: TokenVectors = trigram_vectors) -> Callable[[ColumnOrName, ColumnOrName], Column]:
    """A column of F1 scores by greedy matching of token vectors; ``provider`` gets each distinct text of _MATCH_HELD pairs once and gives a matrix for each, a row for a token."""

    def scored(x: list[str], y: list[str]) -> np.ndarray:
        texts = list(dict.fromkeys([*x, *y]))
        found = dict(zip(texts, provider(texts), strict=True))
        return greedy_match_block([found[t] for t in x], [found[t] for t in y])

    def apply(prediction: ColumnOrName, reference: ColumnOrName) -> Column:
        small_batches(SparkSession.active())

        @F.pandas_udf("double")
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            x, y = x.fillna("").tolist(), y.fillna("").tolist()
            parts = [scored(x[i : i + _MATCH_HELD], y[i : i + _MATCH_HELD]) for i in range(0, len(x), _MATCH_HELD)]
            return pd.Series(np.concatenate(parts) if parts else [], dtype=float)

        return run(prediction, reference)

    return apply


token_match_f1_udf = token_match()
