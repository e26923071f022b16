"""Near-duplicate vectors by lattice hashing.

Each table projects a unit vector by a random orthogonal map to a few groups of eight coordinates
and decodes every group to the nearest point of the E8 lattice; the points together name a cell.
Vectors that are near each other mostly share a cell in some table; each vector is also entered
in the neighbouring cells to which it is nearest, the probes. Vectors that meet in a cell are
compared by cosine in double precision, and a pair counts in one cell only, the first they share,
so links are counted and never listed.

A cell with many vectors is cut into tiles of bounded size that different tasks compare; from each
tile come counts and a spanning forest of its links, both linear in its vectors. Equal vectors form
a class first and only one of them takes part.

Defined results: vectors that are null, empty or zero or have null or non-finite components, and
those without a label, link with nothing (n_links 0, their own component, kept); vectors of other
lengths never meet; repeated ids count as different vectors but one node; an empty table gives no
rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.common import ship, table_cut, tiles
from millrace.llm.components import components

COSINE = 0.98
TABLES = 8
GROUPS = 3  #: groups of eight coordinates in a table's cell
SCALE = 0.3  #: of the lattice, for unit vectors
PROBES = 2
TILE = 2048  #: vectors of a cell that are compared with as many others by one task at once

def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: all with two entries of +-1, and all of +-1/2 with an even number of minus signs."""
    ends = np.array([[(i == a) * s + (i == b) * t for i in range(8)] for a in range(8) for b in range(a + 1, 8) for s in (1, -1) for t in (1, -1)])
    halves = np.array([[1 - 2 * (m >> i & 1) for i in range(8)] for m in range(256) if m.bit_count() % 2 == 0]) / 2
    return np.concatenate([ends, halves])


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    if len(odd):
        d = x[odd] - r[odd]
        k = np.abs(d).argmax(1)
        r[odd, k] += np.where(d[np.arange(len(odd)), k] < 0, -1, 1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice point of each row of eight."""
    a = _nearest_d8(x)
    b = _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def rotations(dim: int, tables: int, groups: int, seed: int = 20240609) -> np.ndarray:
    """For each table, groups * 8 orthonormal directions (as many as there are, the rest zero)."""
    rng = np.random.default_rng([seed, dim])
    out = np.zeros((tables, dim, 8 * groups))
    for t in range(tables):
        q = np.linalg.qr(rng.normal(size=(dim, min(dim, 8 * groups))))[0]
        out[t, :, : q.shape[1]] = q
    return out


def cells(unit: np.ndarray, label: np.ndarray, tables: int = TABLES, groups: int = GROUPS, scale: float = SCALE, probes: int = PROBES) -> np.ndarray:
    """Keys of each vector's cells: for every table its own and ``probes`` neighbouring ones, which may repeat."""
    n, dim = unit.shape
    maps = rotations(dim, tables, groups)
    weight = np.random.default_rng(8).integers(1, 1 << 62, (groups, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.zeros((n, tables, 1 + probes), np.uint64)
    base = W.mix(label.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim))
    for t in range(tables):
        y = unit @ maps[t] / scale
        own = np.zeros(n, np.uint64)
        step, cost = [], []
        for g in range(groups):
            x = y[:, 8 * g : 8 * g + 8]
            c = decode(x)
            own += ((2 * c).astype(np.int64).view(np.uint64) * weight[g]).sum(1, dtype=np.uint64)
            if probes:
                # How far the vector is beyond the wall to each neighbour: the nearest walls first.
                wall = 1.0 - (x - c) @ ROOTS.T
                near = np.argpartition(wall, min(probes, wall.shape[1] - 1), axis=1)[:, :probes]
                cost.append(np.take_along_axis(wall, near, 1))
                step.append(((2 * ROOTS[near]).astype(np.int64).view(np.uint64) * weight[g]).sum(2, dtype=np.uint64))
        keys[:, t, 0] = own
        if probes:
            order = np.argsort(np.concatenate(cost, 1), axis=1)[:, :probes]
            keys[:, t, 1:] = own[:, None] + np.take_along_axis(np.concatenate(step, 1), order, 1)
        keys[:, t] = W.mix(keys[:, t] + base[:, None] + np.uint64(t))
    return keys.reshape(n, -1)


def _vectors(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the usable vectors of each length."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    gone = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    stop = np.cumsum(size)
    for dim in np.unique(size[size > 0]):
        at = np.flatnonzero(size == dim)
        take = (stop[at] - dim)[:, None] + np.arange(dim)
        x = values[take]
        ok = np.isfinite(x).all(1) & ~gone[take].any(1) & (x != 0).any(1)
        yield at[ok], x[ok]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, dim and the components as bytes; dim 0 for unusable vectors."""
    for b in batches:
        body, dim = [b""] * b.num_rows, np.zeros(b.num_rows, np.int64)
        has_label = b.column(1).is_valid().to_numpy(zero_copy_only=False)
        for at, x in _vectors(b.column(2)):
            narrow = x.astype(np.float32)
            same = (narrow == x).all(1)
            for i, full, short, s in zip(at.tolist(), x, narrow, same, strict=True):
                if has_label[i]:
                    body[i] = (short if s else full).tobytes()
                    dim[i] = len(full)
        yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "label": b.column(1), "dim": pa.array(dim), "body": pa.array(body, pa.binary())})


def _matrix(bodies: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64).astype(float) for x in bodies])


def _celler(tables: int, groups: int, scale: float, probes: int) -> Callable:
    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                for i in range(0, part.num_rows, 4096):
                    p = part.slice(i, 4096)
                    keys = cells(_unit(_matrix(p.column(3).to_pylist(), int(dim))), p.column(1).to_numpy(zero_copy_only=False), tables, groups, scale, probes)
                    keys.sort(axis=1)
                    keep = np.ones(keys.shape, bool)
                    keep[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    ends = np.concatenate([[0], np.cumsum(keep.sum(1))])
                    yield pa.RecordBatch.from_pydict({"k": p.column(0), "keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[keep].view(np.int64)))})

    return cell


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under links i, j."""
    low = np.arange(n)
    while True:
        a, b = low[i], low[j]
        if (a == b).all():
            return low
        m = np.minimum(a, b)
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]


def _compare(rows: pa.Table, cosine: float) -> pa.RecordBatch | None:
    """Links of one tile that count in this cell: k, n (links by the weight of the other end) and ``to``, the first of its component in the tile."""
    key, lo, hi = rows["key"][0].as_py(), rows["lo"][0].as_py(), rows["hi"][0].as_py()
    dims = rows["dim"].to_numpy()
    if len(dims) < 2 or (dims != dims[0]).any():
        return None
    u = _unit(_matrix(rows["body"].to_pylist(), int(dims[0])))
    side, label = rows["chunk"].to_numpy(), rows["label"].to_numpy()
    found_i, found_j = [], []
    for a in range(0, len(u), 1024):
        hit = u[a : a + 1024] @ u.T >= cosine
        i, j = np.nonzero(hit)
        i = i + a
        on = (i < j) & (label[i] == label[j])
        if lo < hi:
            on &= side[i] != side[j]
        found_i.append(i[on])
        found_j.append(j[on])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    if not len(i):
        return None
    lists = rows["keys"].combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    keys = np.full((len(u), size.max()), np.iinfo(np.int64).min)
    keys[np.arange(size.max()) < size[:, None]] = lists.flatten().to_numpy()
    keys = keys.view(np.uint64)
    mine, here = np.ones(len(i), bool), np.uint64(key & (2**64 - 1))
    for a in range(0, len(i), 8192):
        x, y = keys[i[a : a + 8192]], keys[j[a : a + 8192]]
        shared = (x[:, :, None] == y[:, None, :]).any(2) & (x != np.uint64(1 << 63))
        mine[a : a + 8192] = np.where(shared, x, np.uint64(2**64 - 1)).min(1) == here
    i, j = i[mine], j[mine]
    if not len(i):
        return None
    weight = rows["m"].to_numpy()
    n = np.bincount(i, weight[j], len(u)) + np.bincount(j, weight[i], len(u))
    k = rows["k"].to_numpy()
    to = k[_forest(len(u), i, j)]
    on = n > 0
    return pa.RecordBatch.from_pydict({"k": pa.array(k[on]), "n": pa.array(n[on].astype(np.int64)), "to": pa.array(to[on])})


def _comparer(cosine: float) -> Callable:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell and tile; a tile is held whole, and its size is bounded."""
        for tile in tiles(batches, 3):
            out = _compare(tile, cosine)
            if out is not None:
                yield out

    return compare


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, groups: int = GROUPS, scale: float = SCALE, probes: int = PROBES, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding, label``."""
    ship(vectors.sparkSession)
    from millrace.llm.common import id_bitmap
    from millrace.llm.near_dup import _common_keys

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = table_cut(rows.mapInArrow(_bodies, "vec_id long, label long, dim long, body binary"), "vectors")
    usable = rows.where("dim > 0 and vec_id is not null")
    classes = usable.groupBy("label", "dim", "body").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("m")).select(F.monotonically_increasing_id().alias("k"), "label", "dim", "body", "class_id", "m")
    classes = table_cut(classes, "classes")
    own = classes.select("k", "class_id", "m", *[F.col(c).alias(f"c_{c}") for c in ("label", "dim", "body")])
    member = rows.join(own, (F.col("label") == F.col("c_label")) & (F.col("dim") == F.col("c_dim")) & (F.col("body") == F.col("c_body")) & F.col("vec_id").isNotNull(), "left").select("vec_id", "k", "class_id", "m")
    member = table_cut(member, "members")
    keyed = table_cut(classes.select("k", "label", "dim", "body").mapInArrow(_celler(tables, groups, scale, probes), "k long, keys array<long>"), "cells")
    full = keyed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select(F.col("key").alias("f_key"), "size")
    full = table_cut(full, "full")
    met = keyed.select(F.col("k").alias("id"), "keys").mapInArrow(_common_keys(id_bitmap(full, "f_key")), "id long, key long").join(full, F.col("key") == F.col("f_key"))
    met = met.select("key", F.col("id").alias("k"), F.expr(f"cast((size + {tile - 1}) div {tile} as int)").alias("g"))
    met = met.withColumn("chunk", F.pmod(F.xxhash64("k", "key"), F.col("g")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    met = met.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", F.col("k").alias("m_k"))
    body = classes.select("k", "label", "dim", "body", "m").join(keyed.select(F.col("k").alias("y_k"), "keys"), F.col("k") == F.col("y_k"))
    tiles = met.join(body, F.col("m_k") == F.col("k")).select("key", "lo", "hi", "chunk", "k", "label", "dim", "m", "keys", "body")
    tiles = tiles.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    part = table_cut(tiles.mapInArrow(_comparer(cosine), "k long, n long, to long"), "links")
    links = part.groupBy("k").agg(F.sum("n").alias("n")).select(F.col("k").alias("n_k"), "n")
    names = classes.select(F.col("k").alias("e_k"), "class_id")
    star = part.where("k <> to").select("k", "to").distinct()
    for x in ("k", "to"):
        star = star.join(names.select(F.col("e_k").alias(f"{x}_k"), F.col("class_id").alias(f"{x}_id")), F.col(x) == F.col(f"{x}_k"))
    edges = star.select(F.col("k_id").alias("a"), F.col("to_id").alias("b")).unionByName(member.where("vec_id <> class_id").select(F.col("vec_id").alias("a"), F.col("class_id").alias("b")))
    found = components(edges).select(F.col("node").alias("f_id"), "component")
    out = member.join(links, F.col("k") == F.col("n_k"), "left").join(found, F.col("vec_id") == F.col("f_id"), "left")
    out = out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("m") - 1, F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
