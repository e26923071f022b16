"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Cyclic boosting visits the features in turn and adds a
small tree of at most three leaves to the feature's lookup table; then it does the same for the
pairs of features that explain most of what is left, with trees over both. A score is a sum of
looked-up values, for whole batches at once.

The fit uses at most FIT_ROWS labelled rows, chosen by a hash of doc_id; that is the documented
bound. Features and scores cover all rows in one pass over the texts without a shuffle.

Defined results: a null or empty text has features of zeros and gets their score; without any
labelled row, or with one class only, every score is the share of good rows among them (1 without
any); a null label is no label; several labels of one document count as their maximum; of rows with one
doc_id the fit takes the one with the least features; repeated rows give repeated results; other columns do not matter and are passed on by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.common import lean, ship, table_cut
from millrace.llm.toxicity import remainder

FIT_ROWS = 20_000  #: labelled rows that are learned from, at most
BINS = 32
PAIR_BINS = 8
PAIRS = 12
ROUNDS = 60
RATE = 0.15

FEATURES = [
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digits", "sentence_marks", "other_marks", "exclamations", "bars", "white", "non_ascii",
    "line_words", "log_lines", "repeated_lines", "distinct_words", "distinct_pairs", "same_neighbours", "commonest_word", "marked_words", "shouted_words", "one_letter_words", "plain_words",
]

_is = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
_CLASS = {
    "upper": _is(bytes(range(65, 91))), "lower": _is(bytes(range(97, 123))), "digit": _is(b"0123456789"), "sentence": _is(b".,;:?"), "bang": _is(b"!"), "bar": _is(b"|"),
    "other": _is(b"\"#$%&'()*+-/<=>@[\\]^_`{}~"), "white": W._SPACE, "high": np.arange(256) >= 128,
}


def _sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[ends] - total[starts]).astype(float)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for w in W.blocks(texts):
        out[w.first : w.first + w.rows] = _features(w)
    return out


def _features(w: W.Words) -> np.ndarray:
    a, b = w.offsets[:-1], w.offsets[1:]
    size = (b - a).astype(float)
    n = np.diff(w.bounds).astype(float)
    lo, hi = w.bounds[:-1], w.bounds[1:]
    count = {k: _sums(m[w.data], a, b) for k, m in _CLASS.items()}
    per = lambda x, y: np.divide(x, y, out=np.zeros_like(x), where=y > 0)
    of_words = lambda flag: per(_sums(flag, lo, hi), n)
    length = w.end - w.start
    doc = w.doc
    # lines: their hashes are sums of the bytes' codes, as those of words
    newline = np.flatnonzero(w.data == 10)
    line_start = np.unique(np.concatenate([a[size > 0], newline + 1]))
    line_start = line_start[line_start < len(w.data)]
    line_end = np.minimum(np.append(line_start[1:], len(w.data)), len(w.data))
    line_doc = np.searchsorted(w.offsets, line_start, "right") - 1
    words_in = np.searchsorted(w.start, line_end) - np.searchsorted(w.start, line_start)
    with np.errstate(over="ignore"):
        full = words_in > 0
        line_hash = np.add.reduceat(w.hash, np.searchsorted(w.start, line_start[full])) * np.uint64(3) + words_in[full].astype(np.uint64) if full.any() else np.zeros(0, np.uint64)
        pair_hash = W.mix(w.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[1:]) if len(w.hash) > 1 else np.zeros(0, np.uint64)
    line_doc = line_doc[full]
    lines = np.bincount(line_doc, minlength=w.rows).astype(float)
    inner = doc[:-1] == doc[1:] if len(doc) > 1 else np.zeros(0, bool)

    def distinct(d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of different hashes of each document and how often the commonest comes."""
        if not len(h):
            return np.zeros(w.rows), np.zeros(w.rows)
        key = np.sort((h & np.uint64((1 << 44) - 1)) | (d.astype(np.uint64) << np.uint64(44)))
        first = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(first)
        kd = (key[at] >> np.uint64(44)).astype(np.int64)
        most = np.zeros(w.rows)
        np.maximum.at(most, kd, np.diff(np.append(at, len(key))))
        return np.bincount(kd, minlength=w.rows).astype(float), most

    kinds, commonest = distinct(doc, w.hash)
    pair_kinds, _ = distinct(doc[:-1][inner], pair_hash[inner])
    line_kinds, _ = distinct(line_doc, line_hash)
    marks = _sums(_CLASS["other"][w.data] | _CLASS["bang"][w.data] | _CLASS["bar"][w.data], w.start, w.end) if len(w.start) else np.zeros(0)
    uppers = _sums(_CLASS["upper"][w.data], w.start, w.end) if len(w.start) else np.zeros(0)
    lowers = _sums(_CLASS["lower"][w.data] | _CLASS["high"][w.data], w.start, w.end) if len(w.start) else np.zeros(0)
    longest = np.zeros(w.rows)
    np.maximum.at(longest, doc, length)
    pairs = np.maximum(n - 1, 0)
    same = np.zeros(w.rows)
    if len(inner):
        same = np.bincount(doc[:-1][inner & (w.hash[:-1] == w.hash[1:])], minlength=w.rows).astype(float)
    cols = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(n), "word_length": per(_sums(np.ones(len(w.data)), a, b) - count["white"], n), "longest_word": np.log1p(longest),
        "upper": per(count["upper"], count["upper"] + count["lower"]), "digits": per(count["digit"], size), "sentence_marks": per(count["sentence"], n), "other_marks": per(count["other"], size),
        "exclamations": per(count["bang"], n), "bars": per(count["bar"], n), "white": per(count["white"], size), "non_ascii": per(count["high"], size),
        "line_words": np.log1p(per(n, lines)), "log_lines": np.log1p(lines), "repeated_lines": per(lines - line_kinds, lines), "distinct_words": per(kinds, n), "distinct_pairs": per(pair_kinds, pairs),
        "same_neighbours": per(same, pairs), "commonest_word": per(commonest, n), "marked_words": of_words(marks > 0), "shouted_words": of_words((uppers > 1) & (lowers == 0)),
        "one_letter_words": of_words(length == 1), "plain_words": of_words((marks == 0) & (lowers > 0)),
    }
    return np.stack([cols[f] for f in FEATURES], axis=1)


@dataclass
class Model:
    bias: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)  #: of each feature
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        if self.cuts:
            b = self.bins(x)
            for k, t in enumerate(self.tables):
                z += t[b[:, k]]
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                z += t[_coarse(b[:, i], self.cuts[i]), _coarse(b[:, j], self.cuts[j])]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _coarse(b: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return b * PAIR_BINS // (len(cuts) + 1)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g**2 / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree of at most three leaves over bins with gradient sums g and curvature sums h."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    n = len(g)
    left = _gain(cg[1:-1], ch[1:-1]) + _gain(cg[-1] - cg[1:-1], ch[-1] - ch[1:-1]) if n > 1 else np.zeros(0)
    edges = [0, n]
    if len(left):
        s = int(np.argmax(left)) + 1
        edges = [0, s, n]
        best, add = 1e-9, None
        for lo, hi in ((0, s), (s, n)):
            t = np.arange(lo + 1, hi)
            if len(t):
                v = _gain(cg[t] - cg[lo], ch[t] - ch[lo]) + _gain(cg[hi] - cg[t], ch[hi] - ch[t]) - _gain(cg[hi] - cg[lo], ch[hi] - ch[lo])
                if v.max() > best:
                    best, add = v.max(), int(t[np.argmax(v)])
        edges = sorted({*edges, *([add] if add else [])})
    out = np.zeros(n)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The values of the best tree that cuts one feature and then the other on each side, over a grid, and its gain."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        ca, cb = np.cumsum(a, 0), np.cumsum(b, 0)
        for s in range(1, len(a)):
            value, table = 0.0, np.zeros_like(a)
            for ga, hb, rows in ((ca[s - 1], cb[s - 1], slice(0, s)), (ca[-1] - ca[s - 1], cb[-1] - cb[s - 1], slice(s, None))):
                x, y = np.cumsum(ga), np.cumsum(hb)
                v = _gain(x[:-1], y[:-1]) + _gain(x[-1] - x[:-1], y[-1] - y[:-1])
                t = int(np.argmax(v)) + 1
                value += v[t - 1]
                table[rows, :t], table[rows, t:] = x[t - 1] / (y[t - 1] + 1.0), (x[-1] - x[t - 1]) / (y[-1] - y[t - 1] + 1.0)
            if value > best:
                best, out = value, table.T if flip else table
    return out, best


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit the tables to features x and labels y (0, 1)."""
    share = float(y.mean()) if len(y) else 1.0
    if not 0 < share < 1:
        return Model(bias=40.0 if share else -40.0)
    m = Model(bias=float(np.log(share / (1 - share))))
    for k in range(x.shape[1]):
        m.cuts.append(np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)))
        m.tables.append(np.zeros(len(m.cuts[k]) + 1))
    b = m.bins(x)
    z = np.full(len(y), m.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, t in enumerate(m.tables):
            r, q = slopes()
            step = RATE * _tree(np.bincount(b[:, k], r, len(t)), np.bincount(b[:, k], q, len(t)))
            t += step
            z += step[b[:, k]]
    c = np.stack([_coarse(b[:, k], m.cuts[k]) for k in range(x.shape[1])], axis=1)
    grid = lambda i, j, v: np.bincount(c[:, i] * PAIR_BINS + c[:, j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    r, q = slopes()
    gains = sorted(((-_pair_tree(grid(i, j, r), grid(i, j, q))[1], i, j) for i in range(x.shape[1]) for j in range(i)))
    m.pairs = [(i, j) for _, i, j in gains[:PAIRS]]
    m.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in m.pairs]
    for _ in range(ROUNDS // 3):
        for (i, j), t in zip(m.pairs, m.pair_tables, strict=True):
            r, q = slopes()
            step = RATE * _pair_tree(grid(i, j, r), grid(i, j, q))[0]
            t += step
            z += step[c[:, i], c[:, j]]
    return m


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(b.column(1))
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))})


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and the features x of every whole text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_feature_rows), "doc_id long, x array<double>")


def label_sample(labels: DataFrame, modulus: int = 5, held_out: int = 0, fit_rows: int = FIT_ROWS) -> DataFrame:
    """l_id and label of the rows to learn from, at most ``fit_rows``."""
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)").where(remainder("l_id", modulus) != held_out)
    return known.groupBy("l_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("l_id"), "l_id").limit(fit_rows)


def fit(table: DataFrame, sample: DataFrame) -> Model:
    """Learn from the rows of a feature table that the bounded sample names; at most one row for each of its ids comes to the driver."""
    rows = table.join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).groupBy("doc_id").agg(F.min("x").alias("x"), F.max("label").alias("label")).toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    order = np.argsort(rows["doc_id"].to_numpy())  # the same fit however rows arrived
    return learn(x[order], rows["label"].to_numpy()[order].astype(float))


def score(table: DataFrame, model: Model, threshold: float = 0.3, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted from a feature table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(model.score(x))})

    scored = table.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text of ``docs``: one pass for the features, a fit on the bounded sample, scores from the features."""
    table = table_cut(feature_table(docs), "features")
    return score(table, fit(table, label_sample(labels)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    sample = label_sample(labels)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample.select("l_id")), F.col("doc_id") == F.col("l_id"), "left_semi")
    model = fit(table_cut(feature_table(named), "features"), sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(features(b.column(at).cast(pa.string()))) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)
