"""Near-duplicate documents by one-permutation MinHash.

A text's shingle set is hashed once; the hash names a bin and the least value in each bin is its
entry. Empty bins borrow by optimal densification: each probes bins in an order of its own until
one is filled, the same for all sets. Bands of entries are the bucket keys. Within a bucket
every text is compared with one centre only, so candidate pairs grow with the rows and not with
their square; what a star cannot settle is compared across the components it left. Candidates
are confirmed on the full sets.

Texts with equal sets form a class first and only its smallest doc_id takes part, so copies cost
nothing. Sets are held as 64-bit hashes of shingles.

With BINS bins and bands of ROWS entries a pair of similarity 0.8 shares no band with probability
(1 - 0.8**ROWS)**(BINS // ROWS), below 3e-6 for the defaults.

Defined results: a null or empty text, or one without words, has an empty set, links with nothing
and is kept; rows with equal doc_id and different texts count as one document for the components (each row is
kept and has its own set size); a null doc_id links with nothing; an empty table gives no rows;
texts of any length are read whole; other columns do not matter and are passed on by the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.common import fresh, id_bitmap, in_bitmap, lean, scramble, ship, table_cut
from millrace.llm.components import components

BINS = 252
ROWS = 6
#: Bits of the sketch that spares comparisons: pairs of similarity 0.8 differ in about 25 of 252
#: bits and in more than 50 with probability about 1e-5; unrelated pairs differ in about 126.
SKETCH_MISSES = 50
_PROBES = 64
_AT_ONCE = 1 << 20
#: Rounds of further centres, centres of a bucket in each, and how many of them an id tries.
ROUNDS, CENTRES, TRIES = 1, 2, 8
#: Ids of a bucket that one task compares with as many others in the last comparison.
TILE = 1024
#: Rows beyond which a class of equal sets may be hot, and how many classes are at most.
HOT_CLASS, MOST_HOT = 1000, 50_000


#: Bits of the finer sketch of sets that share a bucket, one for each bin of a signature of as many
#: bins, and how many may differ: at similarity 0.8 410 do and more than 506 with probability about 1e-5.
FINE_BITS, FINE_MISSES = 4096, 506
#: Below so many shingles one of them may own many bits, and no sketch rules a pair out: the sets themselves decide.
SMALL_SET = 64


@cache
def _order(bins: int) -> np.ndarray:
    """Row t: the bin that each bin asks in its t-th try."""
    return np.random.default_rng([977, bins]).integers(0, bins, (_PROBES, bins))


@cache
def _odd(bins: int) -> np.ndarray:
    return np.random.default_rng([31, bins]).integers(1, 1 << 63, bins, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Densified one-permutation MinHash of a non-empty set of uint64 hashes."""
    asked = _order(bins)
    entry = np.full(bins, np.uint64(2**64 - 1), dtype=np.uint64)
    which = (hashes % np.uint64(bins)).astype(np.int64)
    order = np.argsort(hashes, kind="stable")[::-1] if len(hashes) > 1 else np.zeros(1, np.int64)
    entry[which[order]] = hashes[order]  # of several for one bin the least stays
    filled = np.zeros(bins, dtype=bool)
    filled[which] = True
    out, todo = entry.copy(), np.flatnonzero(~filled)
    for t in range(_PROBES):
        if not len(todo):
            return out
        donor = asked[t, todo]
        ok = filled[donor]
        out[todo[ok]] = entry[donor[ok]]
        todo = todo[~ok]
    # Few bins are filled: each of the rest takes its first in an order of its own over all bins, so no entry is favoured by the gap before it.
    donors = np.flatnonzero(filled)
    for part in np.array_split(todo, 1 + len(todo) * len(donors) // _AT_ONCE):
        order = W.mix(part[:, None].astype(np.uint64) << np.uint64(32) | donors.astype(np.uint64))
        out[part] = entry[donors[order.argmin(axis=1)]]
    return out


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, distinct shingle hashes and their bounds, for blocks of documents."""
    for w in W.blocks(texts):
        values, bounds = W.distinct(*W.shingles(w, size))
        yield w.first, values, bounds


def _signer(size: int) -> Callable:
    multiplier = _odd(BINS)
    bands = BINS // ROWS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            whole = np.zeros(b.num_rows, np.uint64)
            keys = np.zeros((b.num_rows, bands), np.uint64)
            bits = np.zeros((b.num_rows, 4), np.uint64)
            for first, values, bounds in _sets(b.column(1), size):
                n[first : first + len(bounds) - 1] = np.diff(bounds)
                sigs = np.zeros((len(bounds) - 1, BINS), np.uint64)
                for i in np.flatnonzero(np.diff(bounds)):
                    own = values[bounds[i] : bounds[i + 1]]
                    sigs[i] = signature(own)
                    whole[first + i] = W.mix(own).sum(dtype=np.uint64)
                with np.errstate(over="ignore"):
                    mixed = W.mix(sigs * multiplier)
                    k = mixed.reshape(len(sigs), bands, ROWS).sum(axis=2, dtype=np.uint64)
                    keys[first : first + len(sigs)] = W.mix(k + np.arange(bands, dtype=np.uint64))
                low = np.packbits((mixed & np.uint64(1)).astype(np.uint8), axis=1)
                bits[first : first + len(sigs)] = np.pad(low, ((0, 0), (0, 32 - low.shape[1]))).view(np.uint64)
            as_lists = lambda x, m: pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * m, pa.int32()), pa.array(x.ravel().view(np.int64)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_shingles": pa.array(n), "set_hash": pa.array(whole.view(np.int64)), "keys": as_lists(keys, bands), "sketch": as_lists(bits, 4)})

    return sign


def _set_rows(size: int, wanted: np.ndarray) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_bitmap(wanted, b.column(0).fill_null(0).to_numpy(zero_copy_only=False))))
            for first, values, bounds in _sets(b.column(1), size):
                k = len(bounds) - 1
                fine = np.zeros((k, FINE_BITS // 8), np.uint8)
                for i in np.flatnonzero(np.diff(bounds) >= SMALL_SET):
                    fine[i] = np.packbits((W.mix(signature(values[bounds[i] : bounds[i + 1]], FINE_BITS) * _odd(FINE_BITS)) & np.uint64(1)).astype(np.uint8))
                fine_lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * (FINE_BITS // 64), pa.int32()), pa.array(fine.ravel().view(np.int64)))
                yield pa.RecordBatch.from_pydict({"s_id": b.column(0).slice(first, k), "s_n": pa.array(np.diff(bounds)), "s_set": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64))), "s_fine": fine_lists})

    return rows


def _finely_near(a: str, b: str, percent: int) -> Column:
    """Whether sizes and fine sketches, or the sets of small ones, allow a similarity of ``percent`` per cent."""
    ratio = F.least(f"{a}_n", f"{b}_n") * 100 >= F.greatest(f"{a}_n", f"{b}_n") * percent
    one, two = F.col(f"{a}_fine"), F.col(f"{b}_fine")
    part = [F.bit_count(one[i].bitwiseXOR(two[i])) for i in range(FINE_BITS // 64)]
    # The first 256 bits tell most pairs apart: 26 of them differ at similarity 0.8, more than 50 with probability about 1e-5.
    sketches = (sum(part[1:4], part[0]) <= SKETCH_MISSES) & (sum(part[1:], part[0]) <= FINE_MISSES)
    both = F.size(F.array_intersect(f"{a}_small", f"{b}_small"))
    exact = 100 * both >= percent * (F.col(f"{a}_n") + F.col(f"{b}_n") - both)
    return ratio & F.when(F.least(f"{a}_n", f"{b}_n") < SMALL_SET, exact).otherwise(sketches)


def _fine_looks(sets: DataFrame, percent: int) -> DataFrame:
    """What :func:`_finely_near` compares: sizes, fine sketches, and the sets of those near enough to a small one in size."""
    return sets.select(F.col("s_id").alias("k_id"), F.col("s_n").alias("n"), F.col("s_fine").alias("fine"), F.when(F.col("s_n") * percent <= 100 * SMALL_SET, F.col("s_set")).alias("small"))


def _near(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches of two sides allow a similarity of ``percent`` per cent."""
    ratio = F.least(f"{a}_n", f"{b}_n") * 100 >= F.greatest(f"{a}_n", f"{b}_n") * percent
    misses = sum((F.bit_count(F.col(f"{a}_sketch")[i].bitwiseXOR(F.col(f"{b}_sketch")[i])) for i in range(1, 4)), F.bit_count(F.col(f"{a}_sketch")[0].bitwiseXOR(F.col(f"{b}_sketch")[0])))
    return ratio & ((F.least(f"{a}_n", f"{b}_n") < SMALL_SET) | (misses <= SKETCH_MISSES))


def _sets_of(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The full shingle sets (s_id, s_n, s_set) of the rows whose id is among ``ids`` (id), and perhaps of some others."""
    # The bitmap only spares making and shuffling sets that no pair needs; joins with the sets are exact.
    return table_cut(rows.where("d_id is not null").mapInArrow(lean(_set_rows(size, id_bitmap(ids, "id"))), "s_id long, s_n long, s_set array<long>, s_fine array<long>"), "sets")


def compare_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (s_id, s_n, s_set) have 100 * intersection >= percent * union."""
    a = sets.select(F.col("s_id").alias("a_id"), F.col("s_n").alias("a_n"), F.col("s_set").alias("a_set"))
    b = sets.select(F.col("s_id").alias("b_id"), F.col("s_n").alias("b_n"), F.col("s_set").alias("b_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    joined = pairs.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id"))
    return joined.where(100 * both >= percent * (F.col("a_n") + F.col("b_n") - both)).select("a", "b")


def link_by_stars(met: DataFrame, confirm: Callable[[DataFrame], DataFrame], looks: DataFrame | None = None, near: Callable[[str, str], Column] | None = None, fine: DataFrame | None = None, finely: Callable[[str, str], Column] | None = None, larger: DataFrame | None = None, forest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Confirmed links (a, b) that connect what shares a bucket and is linked, from ``key, id, c_id`` (a table).

    First every id is compared with its buckets' centres, then, where components share a bucket, with
    some centres of each bucket, ROUNDS times. Ids of one bucket that are in different components even
    then are compared with each other, so no component is cut in two.
    ``looks`` (k_id and columns) and ``near`` rule out pairs before they are confirmed; ``fine`` and ``finely`` do so in the last comparison.
    ``larger``: the rows of ``met`` whose bucket has more than two ids, if ``near`` rules nothing out: in a bucket of two all is compared at first.
    ``forest`` compares tiles of buckets (``key, lo, hi, id, at``) by itself, in place of the rounds and the last comparison: links (a, b) that connect what each tile
    links, as many as its ids at most.
    """

    def seen(rows: DataFrame, side: str, key: str, looks: DataFrame | None = looks) -> DataFrame:
        if looks is None:
            return rows
        return rows.join(looks.select(*[F.col(c).alias(f"{side}_{c}") for c in looks.columns]), F.col(key) == F.col(f"{side}_k_id"))

    allowed = (lambda x, y: F.lit(True)) if near is None else near
    pairs = met.where(F.col("id") != F.col("c_id")).select(F.least("id", "c_id").alias("a"), F.greatest("id", "c_id").alias("b")).distinct()
    pairs = table_cut(seen(seen(pairs, "a", "a"), "b", "b").where(allowed("a", "b")).select("a", "b").distinct(), "pairs")
    links = table_cut(confirm(pairs), "links")
    met = met if larger is None else larger

    def unsettled() -> DataFrame:
        """Rows (key, id, at) of the buckets that hold more than one component."""
        label = components(links).select(F.col("node").alias("l_id"), F.col("component").alias("label"))
        at = table_cut(met.join(label, F.col("id") == F.col("l_id"), "left").select("key", "id", F.coalesce("label", "id").alias("at")), "labelled")
        split = at.groupBy("key").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo < hi").select(F.col("key").alias("s_key"))
        return table_cut(at.join(split, F.col("key") == F.col("s_key"), "left_semi").distinct(), "split")

    def dealt(at: DataFrame) -> DataFrame:
        """The rows of buckets with a column ``chunk``, once for each tile (lo, hi): a large bucket is cut into chunks, and different tasks compare one with itself or two with each other."""
        sizes = at.groupBy("key").agg(F.expr(f"cast((count(*) + {TILE - 1}) div {TILE} as int)").alias("tiles")).select(F.col("key").alias("t_key"), "tiles")
        rows = at.join(sizes, F.col("key") == F.col("t_key")).withColumn("chunk", F.pmod(F.xxhash64("id", "key"), F.col("tiles")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return rows.select(*at.columns, "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))

    at = unsettled()
    if forest is not None:
        return links if at.isEmpty() else table_cut(links.unionByName(forest(dealt(at))), "links")
    for r in range(ROUNDS):
        if at.isEmpty():
            return links
        # Other centres, some for each bucket: most of a loose group comes together here, at a cost that grows with the rows.
        pick = [F.min_by(F.struct("id", "at"), F.xxhash64("id", "key", F.lit(CENTRES * r + i))) for i in range(CENTRES)]
        centre = at.groupBy("key").agg(F.array(*pick).alias("cs")).select(F.col("key").alias("c_key"), "cs")
        # Of the centres of all its buckets each id tries TRIES: pairs grow with the ids, not with their buckets.
        offered = at.join(centre, F.col("key") == F.col("c_key")).select("id", "key", F.filter("cs", lambda c: c["at"] != F.col("at"))["id"].alias("cs")).where(F.size("cs") > 0)
        some = [F.min_by(F.col("cs")[0] if i % 2 else F.element_at("cs", -1), F.xxhash64("key", "id", F.lit(-1 - TRIES * r - i))) for i in range(TRIES)]
        tried = offered.groupBy("id").agg(F.array_distinct(F.array(*some)).alias("cs")).select("id", F.explode("cs").alias("c"))
        tried = tried.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        tried = table_cut(seen(seen(tried, "a", "a"), "b", "b").where(allowed("a", "b")).select("a", "b").distinct(), "pairs")
        pairs = table_cut(pairs.unionByName(tried), "pairs")
        more = table_cut(confirm(tried), "links")
        if more.isEmpty():
            break
        links = table_cut(links.unionByName(more), "links")
        at = unsettled()
    # A pair that shares several buckets is compared in the first of them only.
    shared = at.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("all")).select(F.col("id").alias("a_id"), "all")
    rows = table_cut(dealt(at.join(shared, F.col("id") == F.col("a_id")).select("key", "id", "at", "all")), "split")
    x, y = (seen(rows.select(*[F.col(c).alias(f"{side}_{c}") for c in rows.columns]), side, f"{side}_id", fine) for side in "xy")
    last = (lambda x, y: F.lit(True)) if finely is None else finely
    here = F.col("x_key") == F.array_min(F.array_intersect("x_all", "y_all"))
    tile = (F.col("x_key") == F.col("y_key")) & (F.col("x_lo") == F.col("y_lo")) & (F.col("x_hi") == F.col("y_hi")) & ((F.col("x_lo") == F.col("x_hi")) | (F.col("x_chunk") != F.col("y_chunk")))
    rest = x.join(y, tile & (F.col("x_id") < F.col("y_id")) & (F.col("x_at") != F.col("y_at")) & last("x", "y") & here)
    rest = table_cut(rest.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    return links if rest.isEmpty() else table_cut(links.unionByName(confirm(rest)), "links")


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``doc_id, text``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("d_id"), F.col("text").cast("string").alias("text"))
    signed = table_cut(rows.mapInArrow(lean(_signer(size)), "doc_id long, n_shingles long, set_hash long, keys array<long>, sketch array<long>"), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    # Only classes of several rows join; of those the largest, of which there are few, reach the rows by broadcast, so that no task gets a whole one.
    classes = full.groupBy("set_hash", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("m")).where("m > 1").select(F.col("set_hash").alias("c_hash"), F.col("n_shingles").alias("c_n"), "class_id", "m")
    classes = table_cut(classes, "classes")
    bound = max(HOT_CLASS, signed.count() // MOST_HOT)  # so at most MOST_HOT classes are hot
    hot, cold = F.broadcast(classes.where(F.col("m") > bound)), classes.where(F.col("m") <= bound)
    same = (F.col("set_hash") == F.col("c_hash")) & (F.col("n_shingles") == F.col("c_n"))
    own = full.select("doc_id", "set_hash", "n_shingles")
    member = own.join(hot, same).unionByName(own.join(hot, same, "left_anti").join(cold, same, "left"), allowMissingColumns=True)
    member = table_cut(member.select(F.col("doc_id").alias("m_id"), F.coalesce("class_id", "doc_id").alias("class_id")).distinct(), "members")
    first = full.join(member.where("m_id = class_id").select("m_id").distinct(), F.col("doc_id") == F.col("m_id"), "left_semi")
    first = table_cut(first.select(F.col("doc_id").alias("id"), "keys").distinct(), "firsts")
    # A bucket's centre is its least scrambled id, the same choice in all buckets: few different stars.
    spread = first.select("id", F.explode("keys").alias("key"))
    stars = spread.groupBy("key").agg(F.count("*").alias("m"), F.min_by("id", scramble(F.col("id"))).alias("c_id")).where("m > 1").select(F.col("key").alias("c_key"), "c_id")
    stars = table_cut(stars, "stars")
    met = first.mapInArrow(lean(_common_keys(id_bitmap(stars, "c_key"))), "id long, key long").join(stars, F.col("key") == F.col("c_key")).select("key", "id", "c_id")
    met = table_cut(met, "buckets")
    looks = full.select(F.col("doc_id").alias("k_id"), F.col("n_shingles").alias("n"), "sketch")
    sets = _sets_of(rows, met.select("id").distinct(), size)
    links = link_by_stars(met, lambda pairs: compare_sets(pairs, sets, percent), looks, lambda x, y: _near(x, y, percent), _fine_looks(sets, percent), lambda x, y: _finely_near(x, y, percent))
    found = components(links)
    # Rows of one doc_id with different texts tie their classes together; else a class has the component of its first row.
    same = member.where("m_id <> class_id").select(F.col("m_id").alias("a"), F.col("class_id").alias("b"))
    ties = member.groupBy("m_id").agg(F.count("*").alias("k")).where("k > 1")
    if not ties.isEmpty():
        found = components(links.unionByName(same))
    of_class = found.select(F.col("node").alias("f_id"), "component")
    hot_of = F.broadcast(hot.select(F.col("class_id").alias("h_id")).distinct().join(of_class, F.col("h_id") == F.col("f_id"), "left").select("h_id", "component"))
    joined = member.join(hot_of, F.col("class_id") == F.col("h_id")).unionByName(member.join(hot_of, F.col("class_id") == F.col("h_id"), "left_anti").join(of_class, F.col("class_id") == F.col("f_id"), "left"), allowMissingColumns=True)
    of_doc = joined.groupBy("m_id").agg(F.min(F.coalesce("component", "class_id")).alias("component"))
    out = signed.select("doc_id", "n_shingles").join(of_doc, (F.col("doc_id") == F.col("m_id")) & (F.col("n_shingles") > 0), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _common_keys(bitmap: np.ndarray) -> Callable:
    """id and key of the rows' keys that are in the bitmap."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
            on = in_bitmap(bitmap, keys)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[on]), "key": pa.array(keys[on])})

    return rows


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without the documents whose component has a smaller doc_id."""
    (gone,) = fresh(docs, "gone_id")
    lost = near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(lost, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
