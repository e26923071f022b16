"""Packing by concatenation: all documents in a row, cut at fixed windows.

Two passes. The first encodes every text once and writes its ids with their place within the partition; the
partitions' totals, summed up, give each partition its place in the whole stream. The second knows from that every
document's global place and cuts it where windows end. A document over a window's end gives a record for each
window, and pieces of one window from different partitions have the same number: no row moves for it.

All windows but the last are full. What is left at the end is cut at powers of two, which need no padding.

Defined results: a null or empty text is its end id alone; a null doc_id stays null; repeated rows are packed as often
as they come; a text of any length is cut as often as it must be; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import lean, ship, table_cut
from millrace.llm.token_files import END_ID, encoded

CAPACITY = 4096
#: Bytes of ids in a batch that a task hands on, about.
_BYTES = 4 << 20

_STREAM = pa.schema([("part", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _encoder(vocabulary: str, end_id: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        for doc_id, ids in encoded(batches, vocabulary, end_id):
            data = ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()
            held.append((part, at, doc_id, len(ids), data))
            at += len(ids)
            size += len(data) + 64
            if size >= _BYTES:
                yield _batch(held, _STREAM)
                held, size = [], 0
        if held:
            yield _batch(held, _STREAM)

    return rows


def token_stream(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """``part, at, doc_id, n, ids``: the ids of every text with their place in its partition, written once. Ids take two bytes each where they fit."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return table_cut(rows.mapInArrow(lean(_encoder(vocabulary, end_id)), "part long, at long, doc_id long, n long, ids binary"), "stream")


def last_cuts(total: int, capacity: int) -> list[int]:
    """Where the sequences after the last full window end: each takes the largest power of two that is left."""
    at, out = total - total % capacity, []
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        out.append(at)
    return out


def _cutter(capacity: int, total: int, keep_ids: bool) -> Callable:
    full = total // capacity * capacity
    ends = last_cuts(total, capacity)

    def sequence(at: int) -> tuple[int, int, int]:
        """Number, start and end of the sequence that holds a place of the stream."""
        if at < full:
            n = at // capacity
            return n, n * capacity, (n + 1) * capacity
        k = next(i for i, end in enumerate(ends) if at < end)
        return full // capacity + k, ends[k - 1] if k else full, ends[k]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for at, doc_id, n, data in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                raw = data.as_py()
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                start = 0
                while start < n:
                    number, low, high = sequence(at + start)
                    length = min(n - start, high - at - start)
                    piece = ids[start : start + length].tobytes()
                    out.append((doc_id, start, length, zlib.crc32(piece), n, number, at + start - low, piece if keep_ids else None))
                    start += length
                    size += len(piece) if keep_ids else 0
                    if len(out) >= 20_000 or size >= _BYTES:
                        yield _batch(out, _PIECES)
                        out, size = [], 0
            if out:
                yield _batch(out, _PIECES)

    return rows


def cut_stream(stream: DataFrame, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of a :func:`token_stream`: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and ``ids`` (four bytes each; null if not asked for)."""
    totals = table_cut(stream.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("size")), "totals")
    total = totals.agg(F.sum("size")).first()[0] or 0
    # A row for each task of the first pass; their running sums are the partitions' places in the stream.
    before = totals.select(F.col("part").alias("b_part"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    placed = stream.join(F.broadcast(before), F.col("part") == F.col("b_part"))
    rows = placed.select((F.col("before") + F.col("at")).alias("at"), "doc_id", "n", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return rows.mapInArrow(lean(_cutter(capacity, total, keep_ids)), schema)


def concatenate(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pack every text of ``doc_id, text``; see :func:`cut_stream`."""
    return cut_stream(token_stream(docs, vocabulary, end_id), capacity, keep_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, n_pieces, ids``: whole sequences from pieces with their ids; a group holds at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"), parts.alias("parts"))
    whole = F.aggregate("parts", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["ids"]))
    return rows.select("sequence_id", "n_tokens", "n_pieces", whole.alias("ids"))
