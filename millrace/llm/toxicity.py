"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and the first four, five and six bytes of longer ones, hashed to
buckets. The machine has a weight for each chosen bucket and a vector whose inner products weigh
pairs, so that two terms together can say more than the sum of both. Buckets are chosen by what their
presence says about the label, and those of words by what they say in pairs beyond what each says
alone: a term may matter only beside another. All pairs of words that enough texts of the sample have are counted, in tiles
that tasks work off.

The fit uses at most FIT_ROWS labelled rows of each class, chosen by a hash of doc_id; that is the
documented bound. Scores cover all rows in one pass without a shuffle.

Defined results: a null or empty text has no term and gets the score of the intercept; without
any labelled row, or with one class only, every score is the share of toxic rows among them (0
without any); a null label is no label; several labels of one document count as their maximum;
of rows with one doc_id the fit takes the least text; repeated rows give repeated results; other
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.common import lean, ship, table_cut

FIT_ROWS = 4000  #: labelled rows of each class that are learned from, at most
FIT_PARTITIONS = 8
BUCKETS = 1 << 24
FEATURES = 2048  #: buckets with a weight for what they say alone, at most
#: Words are tested in pairs that this many texts of the sample have, and one in PAIR_SHARE of them at least; of those that say something in a pair at most PAIR_FEATURES are chosen, the strongest.
PAIR_TEXTS, PAIR_SHARE, PAIR_FEATURES = 20, 200, 1024
#: Words by words of a tile.
PAIR_TILE = 512
EVIDENCE = 4.0  #: square root of the likelihood ratio that a bucket needs
HEADS = (4, 5, 6)
FACTORS = 8


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


def terms(texts: pa.Array, sizes: tuple[int, ...] = HEADS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of documents: the first row, and parallel arrays of row and bucket of each term, not yet distinct."""
    for w in W.blocks(texts, W.NOT_TERM):
        doc = w.doc
        rows, hashes = [doc], [w.hash]
        for size in sizes:
            at, h = W.heads(w, size)
            rows.append(doc[at])
            hashes.append(h)
        yield w.first, np.concatenate(rows), (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Machine:
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  #: ascending
    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and feature number of each distinct known term."""
        maybe = np.zeros(1 << 16, dtype=bool)
        maybe[self.buckets & 0xFFFF] = True
        out = [np.zeros(0, np.int64)]
        n = max(1, len(self.buckets))
        for first, row, bucket in terms(texts):
            on = np.flatnonzero(maybe[bucket & 0xFFFF])
            b = bucket[on]
            k = np.minimum(np.searchsorted(self.buckets, b), n - 1)
            same = self.buckets[k] == b if len(self.buckets) else np.zeros(len(b), bool)
            out.append(np.unique((row[on][same] + first) * n + k[same]))
        pairs = np.concatenate(out)
        return pairs // n, pairs % n

    def score(self, texts: pa.Array) -> np.ndarray:
        row, k = self.hits(texts)
        n = len(texts)
        z = self.bias + np.bincount(row, self.weights[k], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[k, f]
            z += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _count_terms(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...] = HEADS) -> Iterator[pa.RecordBatch]:
    """How many texts of each label have a bucket: label, bucket, n; a row for each bucket and task."""
    found: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for b in batches:
        label = b.column(1).to_numpy(zero_copy_only=False)
        for first, row, bucket in terms(b.column(0), sizes):
            pairs = np.unique(row * BUCKETS + bucket)
            y = label[pairs // BUCKETS + first]
            for c in (0, 1):
                found[c].append(pairs[y == c] % BUCKETS)
    for c, parts in found.items():
        if parts:
            bucket, n = np.unique(np.concatenate(parts), return_counts=True)
            for i in range(0, len(bucket), 100_000):
                part = bucket[i : i + 100_000]
                yield pa.RecordBatch.from_pydict({"label": pa.array(np.full(len(part), c), pa.int64()), "bucket": pa.array(part), "n": pa.array(n[i : i + 100_000], pa.int64())})


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`_count_terms` without the beginnings of words."""
    return _count_terms(batches, ())


def _known_terms(machine: Machine) -> Callable:
    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, k = machine.hits(b.column(0))
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_pydict({"label": b.column(1).cast(pa.int64()), "terms": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(k, pa.int32()))})

    return known


def _choose(counts: DataFrame, n0: int, n1: int) -> np.ndarray:
    """The buckets whose presence says most about the label, by the likelihood ratio; at most FEATURES rows come back."""
    c = counts.groupBy("bucket").agg(F.sum(F.when(F.col("label") == 0, F.col("n"))).alias("a"), F.sum(F.when(F.col("label") == 1, F.col("n"))).alias("b"))
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    total = n0 + n1

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))

    g = 2 * (part(a, (a + b) * n0 / total) + part(b, (a + b) * n1 / total) + part(n0 - a, (total - a - b) * F.lit(n0 / total)) + part(n1 - b, (total - a - b) * F.lit(n1 / total)))
    best = c.select("bucket", g.alias("g")).where(F.col("g") >= EVIDENCE**2).orderBy(F.desc("g"), "bucket").limit(FEATURES)
    return np.sort(np.array([r["bucket"] for r in best.collect()], dtype=np.int64))


def _frequent_words(counts: DataFrame, total: int) -> np.ndarray:
    """The buckets of all words that are tested in pairs. Each is in one of PAIR_SHARE texts of the sample at least, which bounds their number by the sample's words."""
    c = counts.groupBy("bucket").agg(F.sum("n").alias("m")).where((F.col("m") >= max(PAIR_TEXTS, total / PAIR_SHARE)) & (F.col("m") <= 0.95 * total))
    return np.sort(np.array([r["bucket"] for r in c.select("bucket").collect()], dtype=np.int64))


def _ratio(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Likelihood ratio of a cell's counts of both labels against the share of label 1 in all."""
    n = np.maximum(a + b, 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(a > 0, a * np.log(a / (n * (1 - share))), 0) + np.where(b > 0, b * np.log(b / (n * share)), 0))


def _beyond(left: np.ndarray, right: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What pairs of columns of two 0-1 matrices (by text and word) say about y beyond both words alone, by word and word."""
    share, n = float(y.mean()), [float((y == 0).sum()), float((y == 1).sum())]
    one, two = ([x[y == c].sum(0).astype(float) for c in (0, 1)] for x in (left, right))
    both = [(left[y == c].T @ right[y == c]).astype(float) for c in (0, 1)]
    alone = [_ratio(o[0], o[1], share) + _ratio(n[0] - o[0], n[1] - o[1], share) for o in (one, two)]
    cells = [both, [o[:, None] - z for o, z in zip(one, both, strict=True)], [o[None, :] - z for o, z in zip(two, both, strict=True)], [m - o[:, None] - p[None, :] + z for m, o, p, z in zip(n, one, two, both, strict=True)]]
    more = sum(_ratio(*c, share) for c in cells) - alone[0][:, None] - alone[1][None, :]
    # Words that nearly imply each other say nothing as a pair.
    more[sum(both) > 0.8 * np.minimum(sum(one)[:, None], sum(two)[None, :])] = 0
    return more


def _tile_scores(bits: np.ndarray, y: np.ndarray) -> Callable:
    """For tiles (i, j) of words: word, best; what each says at most in a pair of the tile. ``bits``: by word, a bit for each text."""

    def block(k: int) -> np.ndarray:
        return np.unpackbits(bits[k * PAIR_TILE : (k + 1) * PAIR_TILE], axis=1, count=len(y)).T.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                more = _beyond(block(i), block(j), y)
                if i == j:
                    np.fill_diagonal(more, 0)
                word = np.concatenate([np.arange(more.shape[0]) + i * PAIR_TILE, np.arange(more.shape[1]) + j * PAIR_TILE])
                yield pa.RecordBatch.from_pydict({"word": pa.array(word), "best": pa.array(np.concatenate([more.max(1), more.max(0)]))})

    return run


def _paired(spark: SparkSession, rows: np.ndarray, words: np.ndarray, m: int, y: np.ndarray) -> np.ndarray:
    """Of m words those that say more in some pair than both of it alone; at most PAIR_FEATURES. ``rows`` and ``words``: who has what, in parallel.

    The sample's bits go to the tasks: at most 2 * FIT_ROWS of them for a word.
    """
    if m < 2:
        return np.zeros(0, np.int64)
    bits = np.zeros((m, -(-len(y) // 8)), np.uint8)
    np.bitwise_or.at(bits, (words, rows >> 3), (128 >> (rows & 7)).astype(np.uint8))
    n = -(-m // PAIR_TILE)
    tiles = [(i, j) for i in range(n) for j in range(i, n)]
    dealt = spark.createDataFrame(tiles, "i int, j int").repartition(min(len(tiles), 256))
    best = dealt.mapInArrow(lean(_tile_scores(bits, y)), "word long, best double").groupBy("word").agg(F.max("best").alias("best"))
    bound = EVIDENCE**2 + 4 * np.log(m)  # more pairs are tried than words
    found = best.where(F.col("best") >= float(bound)).orderBy(F.desc("best"), "word").limit(PAIR_FEATURES).select("word").collect()
    return np.array([r["word"] for r in found], np.int64)


def _learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 40, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam on the weighted logistic loss."""
    rng = np.random.default_rng(seed)
    p = [np.zeros(1), np.zeros(x.shape[1]), rng.normal(0, 0.05, (x.shape[1], FACTORS))]
    m, s, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    p[0][0] = np.log(max(1e-6, (weight * y).sum()) / max(1e-6, (weight * (1 - y)).sum()))
    size = 256
    for _ in range(max(epochs, -(-600 * size // max(1, len(y))) if len(y) < 2000 else epochs)):
        order = rng.permutation(len(y))
        for at in range(0, len(y), size):
            i = order[at : at + size]
            xi = x[i]
            xv = xi @ p[2]
            z = p[0][0] + xi @ p[1] + 0.5 * (xv**2 - xi @ p[2] ** 2).sum(1)
            e = weight[i] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[i]) / len(i)
            own = xi.T @ e
            grads = [np.array([e.sum()]), own + decay * p[1], xi.T @ (e[:, None] * xv) - own[:, None] * p[2] + decay * p[2]]
            t += 1
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return float(p[0][0]), p[1], p[2]


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, fit_rows: int = FIT_ROWS) -> Machine:
    """Learn from ``labels`` (doc_id, toxic) of rows whose crc32(doc_id) mod ``modulus`` isn't ``held_out``."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1)").where(remainder("l_id", modulus) != held_out)
    known = known.groupBy("l_id").agg(F.max("label").alias("label"))
    sample = [known.where(F.col("label") == c).orderBy(F.xxhash64("l_id"), "l_id").limit(fit_rows) for c in (0, 1)]
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # At most 2 * fit_rows ids: the bound of the broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("d_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample[0].unionByName(sample[1])), F.col("d_id") == F.col("l_id"))
    # One text for each id, whatever rows repeat: what comes to the driver is bounded by the sample.
    rows = rows.groupBy("d_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label")).select("text", "label").repartition(FIT_PARTITIONS)
    rows = table_cut(rows, "toxic-fit")
    got = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = got.get(0, 0), got.get(1, 0)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not n0 or not n1:
        share = n1 / max(1, n0 + n1)
        return Machine(bias=float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    alone = _choose(rows.mapInArrow(lean(_count_terms), "label long, bucket long, n long"), n0, n1)
    frequent = _frequent_words(rows.mapInArrow(lean(_count_words), "label long, bucket long, n long"), n0 + n1)
    machine = Machine(buckets=np.union1d(alone, frequent))
    found = rows.mapInArrow(lean(_known_terms(machine)), "label long, terms array<int>").toArrow()
    y = found["label"].to_numpy().astype(float)
    lists = found["terms"].combine_chunks()
    row, term = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy().astype(np.int64)
    # Words that are frequent only, and those that say something alone too: pairs are sought among both.
    tested = np.full(len(machine.buckets), -1)
    at = np.flatnonzero(np.isin(machine.buckets, frequent))
    tested[at] = np.arange(len(at))
    on = tested[term] >= 0
    keep = np.union1d(np.flatnonzero(np.isin(machine.buckets, alone)), at[_paired(docs.sparkSession, row[on], tested[term[on]], len(at), y)])
    place = np.full(len(machine.buckets), -1)
    place[keep] = np.arange(len(keep))
    on = place[term] >= 0
    x = np.zeros((len(y), len(keep)), dtype=np.float32)
    x[row[on], place[term[on]]] = 1
    machine.buckets = machine.buckets[keep]
    order = np.lexsort((x @ np.sqrt(np.arange(2, 2 + x.shape[1], dtype=np.float32)), y))  # the same fit however rows arrived
    weight = np.where(y == 1, share * len(y) / n1, (1 - share) * len(y) / n0)
    weight = np.sqrt(weight)  # halfway to the labels' own shares: rare toxic texts keep their say
    machine.bias, machine.weights, machine.factors = _learn(x[order], y[order], weight[order])
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(machine.score(b.column(1)))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
