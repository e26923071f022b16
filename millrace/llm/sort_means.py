"""Centroids by sort-means over integer vectors: exact, and a vector meets only the centroids that can be nearer.

A component x becomes floor(SCALE * x), so distances, sums and means are whole numbers that no order of
summation changes. In each round the other centroids are put in order by their distance from each centroid;
a vector starts at the centroid it was assigned to and goes through that centroid's list until the next one is
strictly more than twice as far from it as the vector is: none beyond can be nearer, by the triangle inequality.

Each round reads one table of vectors with their last assignment and writes the next. Every task adds a row for each
centroid with the count and the componentwise sums of its vectors, so the driver gets sums of `centroids` rows;
a round's table goes when the next is complete.

Defined results: vectors that are null, of another number of components, or with null or non-finite ones are not kept, nor are
those with a component of MOST or more, whose squared distances a long can't hold; a null vec_id is a vector
like others that never starts a centroid; repeated rows count as often as they come, and of rows with one id the smallest
vector is the first; fewer vectors than centroids make fewer centroids; an empty table gives no rows; other columns do not
matter. An inertia beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lean, scratch_path, ship, table_cut

CENTROIDS, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Magnitude of a component times SCALE below which squared distances fit a long, and below which they are exact as doubles.
MOST, EXACT = 1 << 27, 1 << 20
#: Vectors that are assigned at once.
_BLOCK = 8192

_ROWS = "vec_id long, v array<int>, cluster int, distance long, n long, sums array<long>, inertia decimal(38,0)"
_ARROW = pa.schema([
    ("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()),
    ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("inertia", pa.decimal128(38)),
])


def _lists(flat: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    width = flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * width, pa.int32()), pa.array(flat.reshape(-1), kind))


def _integers(dim: int, scale: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            on = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
            x = lists.take(pa.array(on)).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
            with np.errstate(over="ignore"):
                v = np.floor(x * scale)
            fits = (np.abs(v) < MOST).all(1)  # false for what isn't a number
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(on[fits])), _lists(v[fits].astype(np.int32), pa.int32())], names=["vec_id", "v"])

    return rows


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` of the vectors that are kept, as whole numbers."""
    ship(rows.sparkSession)
    kind = rows.schema[vector].dataType.simpleString()
    v = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    return rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).mapInArrow(lean(_integers(dim, scale)), "vec_id long, v array<int>")


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number), its squared distance, and how many distances were taken.

    ``before``: the centroid at which each vector's search starts. All arrays hold whole numbers.
    """
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT else np.int64
    x, centroids = x.astype(kind), centroids.astype(kind)
    own = (centroids * centroids).sum(1)
    # A quarter of the squared distance, rounded up: beyond a vector's squared distance if the whole is beyond four times it.
    quarter = -(-(own[:, None] - 2 * (centroids @ centroids.T) + own[None, :]).astype(np.int64) // 4)
    who, best, taken = before.astype(np.int32).copy(), np.zeros(len(x), np.int64), len(x)
    for c in np.unique(before):
        rows = np.flatnonzero(before == c)
        near = ((x[rows] - centroids[c]) ** 2).sum(1).astype(np.int64)
        others = np.argsort(quarter[c], kind="stable")
        others = others[others != c]
        reach = np.searchsorted(quarter[c][others], near, "right")
        at = np.argsort(-reach, kind="stable")
        rows, near, reach = rows[at], near[at], reach[at]
        square, got = (x[rows] * x[rows]).sum(1), np.full(len(rows), c, np.int32)
        for j, o in enumerate(others[: reach[0]].tolist()):
            n = int(np.searchsorted(-reach, -j, "left"))  # those that reach beyond place j
            d = (square[:n] - 2 * (x[rows[:n]] @ centroids[o]) + own[o]).astype(np.int64)
            taken += n
            nearer = (d < near[:n]) | (d == near[:n]) & (o < got[:n])
            near[:n][nearer], got[:n][nearer] = d[nearer], o
        who[rows], best[rows] = got, near
    return who, best, taken


def _assigner(centroids: np.ndarray) -> Callable:
    k, dim = centroids.shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, inertia = np.zeros(k, np.int64), [0] * k
        sums = np.zeros((k, dim), np.int64)

        def settled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
            who, best, _ = assign(x, t["cluster"].to_numpy(), centroids)
            for c in np.unique(who):
                mine = who == c
                count[c] += mine.sum()
                sums[c] += x[mine].sum(0)
                inertia[c] += int(best[mine].astype(object).sum()) if best[mine].max() > 1 << 40 else int(best[mine].sum())
            none = pa.nulls(len(x))
            return pa.RecordBatch.from_arrays([t["vec_id"].combine_chunks(), t["v"].combine_chunks(), pa.array(who), pa.array(best), *(none.cast(f.type) for f in list(_ARROW)[4:])], schema=_ARROW)

        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= _BLOCK:
                yield settled(held)
                held, size = [], 0
        if held:
            yield settled(held)
        on = np.flatnonzero(count)
        if len(on):
            none = pa.nulls(len(on))
            yield pa.RecordBatch.from_arrays([
                none.cast(pa.int64()), none.cast(pa.list_(pa.int32())), pa.array(on, pa.int32()), none.cast(pa.int64()),
                pa.array(count[on]), _lists(sums[on], pa.int64()), pa.array([inertia[c] for c in on], pa.decimal128(38)),
            ], schema=_ARROW)

    return rows


def _start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids come first in the order of a hash; at most k rows reach the driver."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.where("vec_id is not null").withColumn("place", place).orderBy("place", "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in first], np.int64)


def _moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid that has vectors at the floor of their mean, from the rows that the tasks have added."""
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    out = centroids.copy()
    sums = [exact(F.col("sums")[i]).alias(f"s{i}") for i in range(centroids.shape[1])]
    for r in table.where("n is not null").groupBy("cluster").agg(exact(F.col("n")).alias("n"), *sums).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(centroids.shape[1])]
    return out


def _written(vectors: DataFrame, centroids: np.ndarray, before: Column) -> tuple[DataFrame, str]:
    path = scratch_path(vectors.sparkSession, "assigned")
    vectors.select("vec_id", "v", before.cast("int").alias("cluster")).mapInArrow(lean(_assigner(centroids)), _ROWS).write.parquet(path)
    return vectors.sparkSession.read.schema(_ROWS).parquet(path), path


def sort_means(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """Assignments (``vec_id, v, cluster, distance``, and rows of sums with ``n`` not null) of :func:`integer_vectors`, and the final centroids.

    A round that moves no centroid is the last, for those after it would move none.
    """
    spark = vectors.sparkSession
    vectors = table_cut(vectors, "vectors")
    centroids = _start(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], _ROWS), centroids
    rows, before, last = vectors, F.lit(0), None
    for turn in range(rounds + 1):
        rows, path = _written(rows, centroids, before)
        if last:
            old = spark._jvm.org.apache.hadoop.fs.Path(last)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        last, before = path, F.col("cluster")
        moved = _moved(rows, centroids) if turn < rounds else centroids
        if (moved == centroids).all():
            break
        centroids = moved
        rows = rows.where("n is null")
    return rows, centroids


def cluster_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that is kept."""
    table, centroids = sort_means(integer_vectors(rows, key, vector, dim, scale), k, rounds, seed)
    spark = rows.sparkSession
    total = {r["cluster"]: int(r["x"]) for r in table.where("n is not null").groupBy("cluster").agg(F.sum("inertia").alias("x")).collect()}  # at most k rows
    fits = lambda x: x if x < 1 << 63 else None
    each = [(c, fits(x), fits(sum(total.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, x in total.items()]
    info = spark.createDataFrame(each, "i_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = table.where("n is null").join(F.broadcast(info), F.col("cluster") == F.col("i_cluster"))  # a row for each centroid
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", info["inertia"], "centroid_sha256")
