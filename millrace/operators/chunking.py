"""Recursive chunking: sequential within a text, so an Arrow function makes each text's chunks.

What is kept of a split are spans of its pieces, found by bisection in the running sum of their
lengths; a text is put together once for each span.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Separators from coarse to fine, and sizes in characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SIZE, OVERLAP = 2048, 256


def spans(lengths: Sequence[int], gap: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of pieces with ``gap`` characters between them, of about ``size`` characters.

    A run ends before the piece that would make it longer than ``size``. The next one starts as early as leaves
    at most ``overlap`` characters before that piece, and holds the piece whatever its length: so a run may have up to
    ``size`` and ``overlap`` characters and a gap. Where nothing is carried over, the gap before the piece counts all the same, from
    then on.
    """
    # Place k is where piece k would start if the text began with piece 0.
    place = [0, *accumulate(n + gap for n in lengths)]
    first, upto, extra = 0, 1, 0
    while upto <= len(lengths):
        # The run from `first` to k has place[k] - place[first] - gap characters, and `extra` that count too.
        upto = max(upto, bisect_right(place, place[first] + gap + size - extra) - 1)
        yield first, min(upto, len(lengths))
        if upto >= len(lengths):
            return
        first = bisect_left(place, place[upto] - gap + extra - overlap, first, upto)
        if first == upto:
            extra += gap
        upto += 1


def _pieces(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    """A text's parts by the first separator; those longer than ``size`` are chunks by the finer ones."""
    parts = text.split(separators[0]) if separators[0] else list(text)
    return [p for part in parts for p in ([part] if len(part) <= size else _chunks(part, size, overlap, separators[1:]))]


def _chunks(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    parts, between = _pieces(text, size, overlap, separators), separators[0]
    made = (between.join(parts[a:b]) for a, b in spans([len(p) for p in parts], len(between), size, overlap))
    return [c for c in made if not c.isspace() and c]


def chunk_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """The chunks of a text, in order; a text of at most ``size`` characters is one, an empty one none."""
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    return _chunks(text, size, overlap, SEPARATORS)


def chunks(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``key, idx, chunk`` for every chunk of every text."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, size, overlap))

    return docs.select(F.col(key), F.posexplode(cut(F.col(text))).alias("idx", "chunk"))
