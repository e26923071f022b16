"""Words, shingles and their hashes for whole Arrow batches at once.

Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D``, with A-Z lower-cased. A word is
hashed eight bytes at a time, for all words of a batch at once, and each step mixes all bits: words
of at most eight bytes and equal length never collide, others as random numbers do. Equal words have
equal hashes in every process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes up to which a word is hashed along with others; a longer one by itself.
LONG_WORD = 64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For terms: everything but ASCII letters and digits and the bytes of other letters.
NOT_TERM = np.ones(256, dtype=bool)
NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """All words of some consecutive documents."""

    data: np.ndarray  #: bytes of these documents
    offsets: np.ndarray  #: byte offset of each document in data, and the end
    first: int  #: row of the first document
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    hash: np.ndarray  #: uint64
    bounds: np.ndarray  #: word number at which each document starts, and the end
    eights: np.ndarray  #: the eight lower-cased bytes from each place on

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, apart: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words of a string array, in blocks of whole documents; ``apart`` says which bytes stand between words."""
    data, offsets = raw(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        yield _words(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], row, apart)
        row = to


def _words(data: np.ndarray, offsets: np.ndarray, first: int, apart: np.ndarray) -> Words:
    inside = ~apart[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    at_once = eights(_LOWER[data])
    return Words(data, offsets, first, start, end, hashes(at_once, start, end), np.searchsorted(start, offsets), at_once)


def eights(data: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there on as one number; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hashes(at_once: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of the bytes from each start to before its end, from the numbers of :func:`eights`; ``seed`` below 256."""
    size = end - start
    h = mix((size.astype(np.uint64) << np.uint64(8)) + np.asarray(seed, np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    left, k = np.arange(len(start)), 0
    while len(left):
        part = at_once[start[left] + 8 * k] & _LOW_BYTES[np.minimum(size[left] - 8 * k, 8)]
        h[left] = mix(h[left] ^ part)
        k += 1
        left = left[(size[left] > 8 * k) & (size[left] <= LONG_WORD)]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        # The first byte of each number is the byte of its place.
        own = at_once[start[i] : end[i]].astype(np.uint8).tobytes()
        h[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little"))
    return h


def heads(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words longer than ``size`` bytes (at most 8), and hashes of their first ``size`` bytes."""
    at = np.flatnonzero(w.end - w.start > size)
    start = w.start[at]
    return at, hashes(w.eights, start, start + size, 1)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and the bounds of each document's; a shorter document's whole sequence is one."""
    n = np.diff(w.bounds)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count) + np.repeat(w.bounds[:-1], count)
    length = np.repeat(np.minimum(n, size), count)
    out = np.full(len(at), np.uint64(0x51_7C_C1_B7_27_22_0A_95), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            on = length > k
            out[on] = mix(out[on] * np.uint64(0x9E3779B97F4A7C15) + w.hash[at[on] + k])
        out = mix(out + length.astype(np.uint64))
    return out, bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values in ascending order, and their bounds."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = values.copy()
    for i in np.flatnonzero(np.diff(bounds) > 1):
        out[bounds[i] : bounds[i + 1]].sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep], np.searchsorted(doc[keep], np.arange(len(bounds)))
