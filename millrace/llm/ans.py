"""Token files: static range asymmetric numeral system over interleaved lanes.

A file holds one shared table of frequencies, the documents' lengths, an index of blocks (the
checkpoints: place, size and checksums of each) and the blocks. A block is coded on its own with
many interleaved lanes, so blocks decode in parallel and from any checkpoint on.

Layout, little-endian: magic, u64 counts (documents, tokens, blocks, symbols), u32 crc of the
tables; i64 doc ids, u8 whether a doc id is null, u32 token counts; u32 symbols, u32 frequencies;
for each block u64 place, u32 words, u32 tokens, u32 crc of its bytes, u32 crc of its ids; blocks
of u64 lane states and u32 words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"MRANS\x001\n"
PRECISION = 20  #: bits of the frequency scale
LANES = 4096  #: at most; a short block has fewer
BLOCK_TOKENS = 1 << 20
_LOW = np.uint64(1 << 31)


def lanes_of(n: int) -> int:
    """Lanes of a block of n tokens."""
    return min(LANES, max(16, n // 128), n)


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2**PRECISION, each at least 1."""
    total, scale = int(counts.sum()), 1 << PRECISION
    if len(counts) > scale // 2:
        raise ValueError(f"{len(counts)} different ids are too many for {PRECISION} bits")
    f = np.maximum(1, np.floor(counts * (scale / total))).astype(np.int64)
    over = int(f.sum()) - scale
    order = np.argsort(-f, kind="stable")
    while over > 0:  # take from the largest, which it hurts least
        take = np.minimum(f[order] - 1, np.maximum(1, over * f[order] // scale))
        take = np.where(np.cumsum(take) <= over, take, np.maximum(0, over - (np.cumsum(take) - take)))
        f[order] -= take
        over -= int(take.sum())
    f[order[0]] -= over
    return f


def _encode_block(index: np.ndarray, f: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lane states and words for a block of symbol numbers."""
    lanes = lanes_of(len(index))
    fs_all, cs_all = f[index], c[index]
    x = np.full(lanes, _LOW, dtype=np.uint64)
    out: list[np.ndarray] = []
    shift, low32, bits = np.uint64(63 - PRECISION), np.uint64(32), np.uint64(PRECISION)
    for at in range((len(index) - 1) // lanes * lanes, -1, -lanes):
        fs = fs_all[at : at + lanes]
        y = x[: len(fs)]
        full = (y >> shift) >= fs
        if full.any():
            out.append(y[full].astype(np.uint32))
            y = np.where(full, y >> low32, y)
        q = y // fs
        x[: len(fs)] = (q << bits) + (y - q * fs) + cs_all[at : at + lanes]
    return x, np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)


def _decode_block(n: int, x: np.ndarray, words: np.ndarray, symbol: np.ndarray, f: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Symbol numbers of a block."""
    lanes, out, used = len(x), np.empty(n, dtype=symbol.dtype), 0
    mask, bits, low32 = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(32)
    words = words.astype(np.uint64)
    for at in range(0, n, lanes):
        m = min(lanes, n - at)
        y = x[:m]
        slot = y & mask
        s = symbol[slot.astype(np.int64)]
        out[at : at + m] = s
        y = f[s] * (y >> bits) + slot - c[s]
        need = np.flatnonzero(y < _LOW)
        if len(need):
            y[need] = (y[need] << low32) | words[used : used + len(need)]
            used += len(need)
        x[:m] = y
    if used != len(words) or (x != _LOW).any():
        raise ValueError("damaged block: states don't return to their start")
    return out


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids in order, each token's number among them, and their counts."""
    if not len(ids) or int(ids.max()) >= 1 << 24:
        symbols, index, n = np.unique(ids, return_inverse=True, return_counts=True)
        return symbols, index.astype(np.int64), n
    n = np.bincount(ids)
    symbols = np.flatnonzero(n)
    number = np.zeros(len(n), np.int64)
    number[symbols] = np.arange(len(symbols))
    return symbols, number[ids], n[symbols]


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file with these documents."""
    symbols, index, n = _alphabet(ids)
    f = _frequencies(n) if len(n) else np.zeros(0, np.int64)
    c = (np.cumsum(f) - f).astype(np.uint64)
    fu = f.astype(np.uint64)
    blocks, places = [], []
    at = 0
    for i in range(0, len(ids), BLOCK_TOKENS):
        states, words = _encode_block(index[i : i + BLOCK_TOKENS], fu, c)
        body = states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
        part = ids[i : i + BLOCK_TOKENS].astype("<u4")
        places.append((at, len(words), len(part), zlib.crc32(body), zlib.crc32(part.tobytes())))
        blocks.append(body)
        at += len(body)
    place = np.array([p[0] for p in places], "<u8").tobytes() + np.array([p[1:] for p in places], "<u4").tobytes()
    tables = (
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes()
        + np.asarray(counts, "<u4").tobytes() + symbols.astype("<u4").tobytes() + f.astype("<u4").tobytes() + place
    )
    head = MAGIC + np.array([len(doc_ids), len(ids), len(blocks), len(symbols)], "<u8").tobytes()
    return head + np.array([zlib.crc32(tables, zlib.crc32(head))], "<u4").tobytes() + tables + b"".join(blocks)


class TokenFile:
    """A file's tables; :meth:`block` decodes any block by its number."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.docs, self.tokens, self.n_blocks, m = np.frombuffer(data, "<u8", 4, 8).astype(int)
        sizes = [8 * self.docs, self.docs, 4 * self.docs, 4 * m, 4 * m, 8 * self.n_blocks, 16 * self.n_blocks]
        ends = 44 + np.cumsum(sizes)
        if zlib.crc32(data[44 : ends[-1]], zlib.crc32(data[:40])) != int(np.frombuffer(data, "<u4", 1, 40)[0]):
            raise ValueError("damaged tables")
        part = lambda k, kind: np.frombuffer(data, kind, sizes[k] // np.dtype(kind).itemsize, ends[k] - sizes[k])
        self.doc_ids = [None if gone else int(d) for d, gone in zip(part(0, "<i8"), part(1, "u1"), strict=True)]
        self.counts = part(2, "<u4").astype(np.int64)
        self.symbols, f = part(3, "<u4"), part(4, "<u4").astype(np.int64)
        self._f, self._c = f.astype(np.uint64), (np.cumsum(f) - f).astype(np.uint64)
        self._symbol = np.repeat(np.arange(m, dtype=np.int32), f)
        self._place, self._index = part(5, "<u8").astype(int) + int(ends[-1]), part(6, "<u4").reshape(-1, 4).astype(int)
        self._data = data

    def block(self, k: int) -> np.ndarray:
        words, n, crc, ids_crc = self._index[k]
        lanes = lanes_of(n)
        body = self._data[self._place[k] : self._place[k] + 8 * lanes + 4 * words]
        if zlib.crc32(body) != crc:
            raise ValueError(f"damaged block {k}")
        s = _decode_block(n, np.frombuffer(body, "<u8", lanes).astype(np.uint64), np.frombuffer(body, "<u4", words, 8 * lanes), self._symbol, self._f, self._c)
        ids = self.symbols[s].astype(np.uint32)
        if zlib.crc32(ids.tobytes()) != ids_crc:
            raise ValueError(f"block {k} decodes to other ids")
        return ids

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Every document's ids in the order of the file; holds the blocks of one document at a time."""
        have, k = np.zeros(0, np.uint32), 0
        for doc_id, n in zip(self.doc_ids, self.counts, strict=True):
            parts = [have]
            size = len(have)
            while size < n:
                parts.append(self.block(k))
                size += len(parts[-1])
                k += 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield doc_id, have[:n]
            have = have[n:]
