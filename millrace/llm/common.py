"""Shared ground for the training-data operators: scratch tables, shipping code, bounded semi-join bitmaps.

Nothing here is kept on one machine: intermediate tables go to the folder named by
``spark.checkpoint.dir``, which the driver and every executor share, so a lost executor costs a
re-read and never a recomputation from the start.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import scratch_path, scratch_root, ship, table_cut

__all__ = ["documents", "fresh", "id_bitmap", "in_bitmap", "lean", "scramble", "scratch_path", "scratch_root", "ship", "table_cut", "tiles", "xxhash64_long"]

#: Bits held by one row of Spark's bitmap aggregates.
BITS_PER_BUCKET = 32768
#: Size of a semi-join bitmap; 2**25 bits are 4 MB whatever the input size.
BITMAP_BITS = 1 << 25


def lean(rows: Callable) -> Callable:
    """``rows`` (batches to batches) that gives freed memory back when a task ends: its worker process lives on for tasks of other stages."""

    @wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns of ``df``."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_bitmap(df: DataFrame, key: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap over hashes of ``key`` (long), built by partial aggregation; ``bits / 8`` bytes reach the driver.

    It only spares later shuffles: a set bit can be a false hit, a clear bit never is, so whoever
    filters by it joins exactly afterwards. With more keys than bits it lets all rows through.
    """
    pos = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    rows = (
        df.select(pos.alias("pos"))
        .select(F.expr(f"pos div {BITS_PER_BUCKET}").alias("bucket"), F.pmod("pos", F.lit(BITS_PER_BUCKET)).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg(F.col("bit")).alias("map"))
        .collect()
    )
    out = np.zeros(bits // 8, dtype=np.uint8)
    step = BITS_PER_BUCKET // 8
    for r in rows:
        out[r["bucket"] * step : (r["bucket"] + 1) * step] = np.frombuffer(bytes(r["map"]), dtype=np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 keys may be in the bitmap of :func:`id_bitmap`."""
    pos = (xxhash64_long(keys).view(np.int64) % np.int64(len(bitmap) * 8)).astype(np.int64)
    return (bitmap[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1


def xxhash64_long(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each int64, equal to Spark's ``xxhash64`` of a long."""
    p1, p2, p3, p4, p5 = (
        np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9),
        np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5),
    )
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.full(len(values), np.uint64(seed) + p5 + np.uint64(8), dtype=np.uint64)
        h ^= rot(values.astype(np.int64).view(np.uint64) * p2, 31) * p1
        h = rot(h, 27) * p1 + p4
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        h ^= h >> np.uint64(32)
    return h


def tiles(batches: Iterator[pa.RecordBatch], tags: int) -> Iterator[pa.Table]:
    """The runs of rows that are equal in the first ``tags`` columns (numbers), each as one table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        tag = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(tags)], axis=1)
        cuts = [0, *(np.flatnonzero((tag[1:] != tag[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if held and any(held[0].column(c)[0].as_py() != int(tag[a, c]) for c in range(tags)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def scramble(c: Column) -> Column:
    """A bijection of longs by shifts and exclusive ors: random priorities that never collide."""
    c = c.bitwiseXOR(F.shiftleft(c, 13))
    c = c.bitwiseXOR(F.shiftrightunsigned(c, 7))
    return c.bitwiseXOR(F.shiftleft(c, 17))
