"""Packing of token sequences: dominance reduction on the histogram of lengths, then best fit.

Pieces differ only in length, and there are at most ``capacity`` lengths, so the plan is made from
their counts on the driver: its size is bounded by the capacity and not by the rows. It is a list
of (how many sequences, what lengths in each). Rows then find their place by their rank among the
pieces of equal length, which is counted in buckets: no length, however common, meets in
one task.

The order of the ranks is free. By default it is that of a hash; where rows come in an order that counts,
as after mixing, ranks follow it, and the plan is dealt to WINDOWS parts of equal shares: each part's
sequences hold pieces from the same part of the order, and sequence numbers ascend with it.

Reduction (Martello and Toth): a set of at most three pieces that contains a given piece and
dominates all others that could share its sequence is fixed for good and leaves the instance:
an exact pair, the largest partner if no two others fit beside the piece or if it is at least as large as
the best fitting pair and no three fit, and the piece alone if nothing fits. What is left is packed best fit, longest first.

Defined results: a null or empty text is its end id alone; repeated rows are packed as often as
they come; an empty table gives no rows; a null doc_id stays null; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import lean, ship, table_cut
from millrace.llm.token_files import END_ID, encoded

CAPACITY = 1024
#: Hash buckets in which the ranks of equal lengths are counted: for each partition of a shuffle at least, and so many that a bucket has about BUCKET_ROWS pieces.
BUCKETS_PER_PARTITION, BUCKET_ROWS = 4, 50_000
#: Parts of the order to which the plan is dealt, and parts of a length's ranks by which rows look for their place.
WINDOWS = 64

_NUMBERS = ("doc_id", "piece", "start", "length", "ids_crc32")
_PIECES = pa.schema([*((n, pa.int64()) for n in _NUMBERS), ("p_group", pa.string()), ("p_at", pa.int64())])


def _cutter(vocabulary: str, end_id: int, capacity: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        places: list = []

        def noted() -> Iterator[pa.RecordBatch]:
            for b in batches:
                places[:] = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
                places.reverse()
                yield b

        for doc_id, ids in encoded(noted(), vocabulary, end_id):
            place = places.pop()
            data = ids.astype("<u4")
            start = 0
            for k in range(-(-len(ids) // capacity)):
                length = (len(ids) - 1) % capacity + 1 if k == 0 else capacity
                rows.append((doc_id, k, start, length, zlib.crc32(data[start : start + length].tobytes()), *place))
                start += length
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return cut


def pieces(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY, place: tuple[Column, Column] | None = None) -> DataFrame:
    """Token pieces of ``doc_id, text``: only texts of more than ``capacity`` ids are cut, the first piece is what remains.

    ``place``: a string and a number by which the rows are in order; rows with one string are ranked by one task.
    """
    ship(docs.sparkSession)
    group, at = place or (F.lit(None), F.lit(None))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), group.cast("string").alias("p_group"), at.cast("long").alias("p_at"))
    return rows.mapInArrow(lean(_cutter(vocabulary, end_id, capacity)), ", ".join(f"{n} long" for n in _NUMBERS) + ", p_group string, p_at long")


def file_order(docs: DataFrame, rows: int = 1 << 16) -> tuple[Column, Column] | None:
    """The order of a written table's rows, for :func:`pieces`: by file, ``rows`` in a row of it, and row; None if ``docs`` isn't read from files."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return None
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    return F.concat(file, F.lit("/"), F.lpad((row / rows).cast("long").cast("string"), 12, "0")), row


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], dict[int, int]]:
    """The sequences fixed by dominance as (how many, [(length, how often)]), and the counts that are left."""
    n = {k: v for k, v in counts.items() if v}
    fixed: list[tuple[int, list[tuple[int, int]]]] = []

    def fix(times: int, lengths: list[tuple[int, int]]) -> None:
        fixed.append((times, lengths))
        for length, m in lengths:
            n[length] -= times * m
            if not n[length]:
                del n[length]

    # An exact pair dominates every other set with either of its pieces.
    for a in sorted(n, reverse=True):
        b = capacity - a
        if a in n and a > b and b in n:
            fix(min(n[a], n[b]), [(a, 1), (b, 1)])
        elif a in n and a == b and n[a] > 1:
            fix(n[a] // 2, [(a, 2)])
        elif a == capacity:
            fix(n[a], [(a, 1)])
    for a in sorted(n, reverse=True):
        while a in n:
            room = capacity - a
            left = sorted(k for k in n if k <= room and (k != a or n[k] > 1))
            if not left:
                fix(n[a], [(a, 1)])
                continue
            least = [k for k in left[:3] for _ in range(min(3, n[k] - (k == a)))][:3]
            large = left[-1]
            pair = 0
            if len(least) > 1 and least[0] + least[1] <= room:
                j = len(left) - 1
                for i, k in enumerate(left):  # the largest sum of two that fits
                    while j >= i and k + left[j] > room:
                        j -= 1
                    if j < i:
                        break
                    if j > i or n[k] - (k == a) > 1:
                        pair = max(pair, k + left[j])
                    elif j > 0 and j - 1 >= i:
                        pair = max(pair, k + left[j - 1])
                if large < pair or len(least) > 2 and sum(least) <= room:
                    break  # nothing dominates: this length stays for best fit
            times = n[a] // 2 if large == a else min(n[a], n[large])
            fix(times, [(a, 2)] if large == a else [(a, 1), (large, 1)])
    return fixed, n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, on counts: equal sequences are handled as one group."""
    groups: dict[int, list[tuple[int, tuple]]] = {}  # by free room: (how many, lengths)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in groups if r >= length), default=capacity)
            if room == capacity:
                times, lengths = left, ()
            else:
                times, lengths = groups[room].pop()
                if not groups[room]:
                    del groups[room]
            each = room // length
            full = min(times, left // each)
            if full:
                groups.setdefault(room - each * length, []).append((full, (*lengths, (length, each))))
                left -= full * each
            rest = times - full
            if room == capacity:
                rest = min(rest, 1)
            if rest and left and left < each:
                groups.setdefault(room - left * length, []).append((1, (*lengths, (length, left))))
                left, rest = 0, rest - 1
            if rest and room < capacity:
                groups.setdefault(room, []).append((rest, lengths))
    return [(times, list(lengths)) for g in groups.values() for times, lengths in g]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def deal(made: list[tuple[int, list[tuple[int, int]]]], counts: dict[int, int], windows: int) -> np.ndarray:
    """The plan as rows (length, part of its ranks, from, to, first rank, each, first sequence, offset) for :func:`pack`.

    Each window gets its share of every group of equal sequences, so ranks and sequences run through the plan together.
    """
    slots, used, sequence = [], defaultdict(int), 0
    step = {length: -(-n // WINDOWS) for length, n in counts.items()}
    for w in range(windows):
        for g, (times, lengths) in enumerate(made):
            shift = g * 40503 % 65536  # shares are rounded at places that differ by group
            share = ((w + 1) * times * 65536 // windows + shift) // 65536 - (w * times * 65536 // windows + shift) // 65536
            if not share:
                continue
            offset = 0
            for length, each in lengths:
                first, last = used[length], used[length] + share * each
                for part in range(first // step[length], (last - 1) // step[length] + 1):
                    slots.append((length, part, max(first, part * step[length]), min(last, (part + 1) * step[length]), first, each, sequence, offset))
                used[length] = last
                offset += each * length
            sequence += share
    return np.array(slots, np.int64).reshape(-1, 8)


def pack(cut: DataFrame, capacity: int = CAPACITY, ordered: bool = False) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (a table that can be read again); ``ordered``: ranks follow ``p_group`` and ``p_at``."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = deal(plan(counts, capacity), counts, WINDOWS if ordered else 1)
    names = ("s_length", "s_part", "s_from", "s_to", "s_first", "s_each", "s_sequence", "s_offset")
    slot = spark.createDataFrame(pa.table({n: pa.array(slots[:, k]) for k, n in enumerate(names)}), ", ".join(f"{n} long" for n in names))
    buckets = max(BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(counts.values()) // BUCKET_ROWS))
    rows = cut.withColumn("p_bucket", F.col("p_group") if ordered else F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sums = rows.groupBy("length", "p_bucket").agg(F.count("*").alias("p_n"))
    by_length = Window.partitionBy("length")
    before = sums.select(
        F.col("length").alias("b_length"), F.col("p_bucket").alias("b_bucket"), (F.sum("p_n").over(by_length.orderBy("p_bucket")) - F.col("p_n")).alias("p_before"),
        F.expr(f"(sum(p_n) OVER (PARTITION BY length) + {WINDOWS - 1}) div {WINDOWS}").alias("p_step"),
    )
    rows = rows.join(before, (F.col("length") == F.col("b_length")) & F.col("p_bucket").eqNullSafe(F.col("b_bucket")))
    own = Window.partitionBy("length", "p_bucket").orderBy(*(["p_at"] if ordered else []), "doc_id", "piece", "start", "ids_crc32")
    rows = rows.withColumn("p_rank", F.col("p_before") + F.row_number().over(own) - 1)
    # The slots are a plan for at most `capacity` lengths and WINDOWS parts: their number doesn't grow with the rows.
    here = (F.col("length") == F.col("s_length")) & (F.expr("p_rank div p_step") == F.col("s_part")) & (F.col("p_rank") >= F.col("s_from")) & (F.col("p_rank") < F.col("s_to"))
    placed = rows.join(F.broadcast(slot), here)
    k = F.col("p_rank") - F.col("s_first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("s_sequence") + F.expr("(p_rank - s_first) div s_each")).alias("sequence_id"),
        (F.col("s_offset") + F.pmod(k, F.col("s_each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY, place: tuple[Column, Column] | None = None) -> DataFrame:
    """Pack every text of ``doc_id, text`` into sequences of at most ``capacity`` ids; ``place`` as in :func:`pieces`."""
    return pack(table_cut(pieces(docs, vocabulary, end_id, capacity, place), "pieces"), capacity, place is not None)
