"""Greedy near-duplicate removal in order: a row goes if an earlier row that stays is near it.

This is the first maximal independent set of the similarity graph and not its components: of a
chain A~B~C without A~C, A and C stay. Rounds settle every row whose earlier neighbours are
settled; the graph meets the next round through a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import bind, words
from millrace.storage import ship, table_cut

THRESHOLD = 0.85
SHINGLE = 5
PERMUTATIONS, BANDS = 128, 32
#: Ids up to which they are broadcast to the sets they name (counted, else a shuffle).
FEW_IDS = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    return table_cut(df, "dedup")


def shingle_set(text: Column, size: int = SHINGLE) -> Column:
    """Distinct runs of ``size`` lower-case words; a shorter text is one shingle, as it is."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    return bind(words(F.lower(text)), lambda w: F.array_distinct(F.when(F.size(w) >= size, runs(w)).otherwise(F.array(F.lower(text)))))


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """A hash of hashes for each seed: two rounds of multiplying and shifting."""
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(29))


def _signatures(lists: pa.Array, permutations: int) -> np.ndarray:
    """The least hash of each list under each seed, by list and seed; lists aren't empty."""
    h = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.concatenate([[0], ends[:-1]])
    return np.stack([np.minimum.reduceat(_mixed(h, s), starts) for s in range(1, permutations + 1)], axis=1)


def signatures(docs: DataFrame, key: str, text: str, permutations: int = PERMUTATIONS) -> DataFrame:
    """``id, sig``: for each text the least hash of its shingles under each seed, all seeds in one pass over the hashes; null texts have none."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sig = _signatures(part.column(1), permutations).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * permutations, pa.int32()), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["id", "sig"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.transform(shingle_set(F.col(text)), lambda x: F.xxhash64(x)).alias("s"))
    return rows.mapInArrow(run, f"id {kind}, sig array<long>")


def minhash_candidates(docs: DataFrame, key: str, text: str, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """The buckets that more than one text is in: ``bucket, id, centre``.

    Two texts are candidates if they share a bucket; candidate pairs are named by membership, for a bucket's pairs grow with its
    square. ``centre`` is the bucket's least id. Each bucket is one band of the signature.
    """
    rows = permutations // bands
    signed = signatures(docs, key, text, permutations)
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.array_join(F.transform(F.slice(F.col("sig"), b * rows + 1, rows), lambda x: x.cast("string")), ",")))
    keyed = cut(signed.select("id", F.explode(band).alias("bucket")).distinct())
    centre = keyed.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1").select("bucket", "centre")
    return keyed.join(centre, "bucket").select("bucket", "id", "centre")


def _few(ids: DataFrame) -> DataFrame:
    """Ids, written and marked for broadcast if they are at most FEW_IDS."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def jaccard_classes(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Texts with equal shingles as classes, and the pairs of classes with a similarity of at least ``threshold``; exact.

    The classes: ``rep, id``, a row for each text, of which ``rep`` is the least id of its class. The pairs: ``a, b, jaccard`` with a < b, of reps. All
    texts of two classes are as similar as their reps, and those of one class are equal, so nothing is lost and no pair of ids is spelled out.
    By prefixes: a pair of that similarity shares one of each side's first n - ceil(t * n) + 1 shingles
    in a global order from rare to common, so only those are joined. A null text is in no class.
    """
    sets = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.transform(shingle_set(F.col(text), size), lambda x: F.xxhash64(x)).alias("s"))
    sets = sets.select("id", F.array_sort(F.array_distinct("s")).alias("s")).withColumn("k", F.xxhash64("s"))
    sets = cut(sets)
    # Only keys and ids are shuffled for the classes; the sets of those that aren't the first of theirs are left out where they lie.
    classes = cut(sets.groupBy("k").agg(F.min("id").alias("rep")))
    members = cut(sets.select("id", F.col("k").alias("m_k")).join(classes, F.col("m_k") == F.col("k")).select("rep", "id", "k"))
    named = sets.join(_few(members.where("rep <> id").select(F.col("id").alias("c_id"), F.col("k").alias("c_k"))), (F.col("id") == F.col("c_id")) & (F.col("k") == F.col("c_k")), "left_anti").select(F.col("id").alias("rep"), "s")
    tokens = named.select("rep", F.size("s").alias("n"), F.explode("s").alias("h"))
    # Shingles of one text only come first in the order and join nothing: their number moves the prefix. One shuffle counts a shingle's texts and keeps their rows.
    counted = tokens.withColumn("df", F.count("*").over(Window.partitionBy("h"))).where("df > 1")
    shared = counted.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("o"))
    length = (F.col("n") - F.ceil(F.col("n") * threshold) + 1 - (F.col("n") - F.size("o"))).cast("int")
    prefix = cut(shared.withColumn("p", length).where("p > 0").select("rep", "n", F.explode(F.slice("o", F.lit(1), F.col("p"))).alias("x")).select("rep", "n", "x.h"))
    left, right = (prefix.select(F.col("rep").alias(f"{p}_rep"), F.col("n").alias(f"{p}_n"), F.col("h").alias(f"{p}_h")) for p in "lr")
    close = (F.col("l_h") == F.col("r_h")) & (F.col("l_rep") < F.col("r_rep")) & (F.least("l_n", "r_n") >= F.lit(threshold) * F.greatest("l_n", "r_n"))
    pairs = cut(left.join(right, close).select("l_rep", "r_rep").distinct())
    named = cut(named.join(_few(pairs.select(F.explode(F.array("l_rep", "r_rep")).alias("p_id")).distinct()), F.col("rep") == F.col("p_id"), "left_semi").dropDuplicates(["rep", "s"]))
    one, two = (named.select(F.col("rep").alias(f"{p}_id"), F.col("s").alias(f"{p}_s")) for p in "lr")
    both = F.size(F.array_intersect("l_s", "r_s"))
    found = pairs.join(one, F.col("l_rep") == F.col("l_id")).join(two, F.col("r_rep") == F.col("r_id")).withColumn("jaccard", both / (F.size("l_s") + F.size("r_s") - both)).where(F.col("jaccard") >= threshold)
    return members.select("rep", "id"), found.select(F.col("l_rep").alias("a"), F.col("r_rep").alias("b"), "jaccard")


def greedy(pairs: DataFrame) -> DataFrame:
    """``id, kept`` for every id in a pair (a before b); ids in no pair stay."""
    links = cut(pairs.select("a", "b").distinct())
    state = cut(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while not state.where("kept is null").isEmpty():
        before = state.select(F.col("id").alias("s_id"), F.col("kept").alias("s_kept"))
        seen = links.join(before, F.col("a") == F.col("s_id")).groupBy("b").agg(F.bool_or(F.coalesce("s_kept", F.lit(False))).alias("blocked"), F.bool_or(F.col("s_kept").isNull()).alias("open"))
        out = state.join(seen, F.col("id") == F.col("b"), "left")
        settled = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("blocked"), F.lit(False)).when(F.coalesce("open", F.lit(False)), F.lit(None).cast("boolean")).otherwise(F.lit(True))
        state = cut(out.select("id", settled.alias("kept")))
    return state


def deduplicate(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``kept``; by row id and never by text.

    Of a class of equal texts the one with the least id is decided on in the graph of classes: if it stays, the others go because of it, and if it goes, they go
    because of the same earlier text.
    """
    members, pairs = jaccard_classes(docs, key, text, threshold)
    lost = greedy(pairs).where("not kept").select("id").unionByName(members.where("rep <> id").select("id")).distinct().select(F.col("id").alias("v_id"))
    return docs.join(lost, F.col(key) == F.col("v_id"), "left").withColumn("kept", F.col("v_id").isNull()).drop("v_id")
