"""Counts of characters and of neighbouring characters of token sets: a quick bound on their edit distance.

The token set of a text is its distinct tokens with single spaces between them. Its characters, and the pairs of neighbours with a
space at either end, are the same in whatever order the tokens stand. One inserted or deleted character changes one count of
characters, and three counts of neighbours at most; hashing to a fixed number of places only brings counts nearer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import ship

#: Places for characters and for neighbours; counts stop at MOST, which only brings them nearer.
CHARS, NEIGHBOURS, MOST = 64, 512, (1 << 15) - 1


def profile(text: str) -> tuple[int, np.ndarray]:
    """The length of a text's token set and its counts."""
    whole = " ".join(set(text.split()))
    c = np.frombuffer(f" {whole} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    chars = np.bincount(c[1:-1] % CHARS, minlength=CHARS)
    pairs = np.bincount((c[:-1] * 31 + c[1:]) % NEIGHBOURS, minlength=NEIGHBOURS) if whole else np.zeros(NEIGHBOURS, np.int64)
    return len(whole), np.minimum(np.concatenate([chars, pairs]), MOST).astype(np.int16)


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [profile(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
        more = [pa.array([n for n, _ in found], pa.int32()), pa.array([p.astype("<i2").tobytes() for _, p in found], pa.binary())]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], "chars", "profile"])


def with_profile(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``chars`` and ``profile`` of the token sets of a column."""
    ship(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.select("*", F.col(text).alias("profiled text")).mapInArrow(_profiled, f"{schema}, chars int, profile binary")


@dataclass
class Profiles:
    """Texts of a block in the order of their lengths, with their counts."""

    texts: list[str]
    chars: np.ndarray
    counts: np.ndarray
    columns: np.ndarray = field(init=False)
    used: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.columns = np.ascontiguousarray(self.counts[:, :CHARS].T)
        self.used = np.flatnonzero(self.columns.any(1))

    @classmethod
    def of(cls, texts: list[str]) -> Profiles:
        found = sorted(((*profile(t), t) for t in texts), key=lambda x: (x[0], x[2]))
        return cls([t for _, _, t in found], np.array([n for n, _, _ in found]), np.stack([p for _, p, _ in found]))

    def near(self, text: str, raw: bytes, t: float) -> list[int]:
        """The texts whose token sets may be as near to ``text`` as ``t`` by their edit distance; ``raw``: its counts."""
        n = len(" ".join(set(text.split())))
        low = np.searchsorted(self.chars, n * t / (2 - t) - 1e-6, "left")
        high = np.searchsorted(self.chars, n * (2 - t) / t + 1e-6, "right") if t > 0 else len(self.chars)
        own, held = np.frombuffer(raw, "<i2"), self.counts[low:high]
        most = (1 - t) * (self.chars[low:high] + n) + 1e-6
        # A column at a time: differences of characters that no text of the block has are own[..] for all.
        apart = np.full(high - low, own[:CHARS].sum(dtype=np.int64) - own[self.used].sum(dtype=np.int64), np.int32)
        if low < high and self.chars[high - 1] + n <= MOST:
            apart = apart.astype(np.int16)  # no sum of differences is larger than both lengths
        for d in self.used:
            apart += np.abs(self.columns[d, low:high] - own[d])
        on = np.flatnonzero(apart <= most)
        on = on[np.abs(held[on, CHARS:] - own[CHARS:]).sum(1) <= 3 * most[on]]
        return (on + low).tolist()
