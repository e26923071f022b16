"""Repeated passages by MinHash banding of paragraphs.

Paragraphs are a text's lines of at least MIN_WORDS words. A line of more than LONG_LINE words is also cut
into segments of sentences, at those whose hash is the least among AROUND on either side: so a long line
is cut alike wherever its sentences stand, and segments of one line do not overlap.

Whatever its sentences and lines, SHARED equal words of two texts hold an equal run of RUN words: its
starts are winnowed over the hashes of SHINGLE words, one at least in each SHARED - RUN + 1 words in a row. Such runs
are found by one key, the hash of their words; edited passages are left to the lines and segments.

Each paragraph has BANDS MinHash entries over its five-word shingles, and as many bands of two
neighbouring entries, the last with the first: a pair of similarity 0.8 shares none with
probability 0.005, a pair of 0.9 with 0.0002. Equal paragraphs are one from the start. Only band keys are counted over
all paragraphs; those that come again are joined, colliding paragraphs are compared with the
centre of their bucket by exact Jaccard similarity on full shingle sets; then buckets in which not all is linked are
compared whole, in tiles of bounded size of which each gives a spanning forest of its links; and linked ones are clustered by components. The first text with a passage of a cluster (by doc_id) keeps it; from the others it is removed.
What repeats within one text only stays.

Defined results: a null or empty text, and one without a long enough paragraph, has nothing to
remove; a null doc_id counts as the smallest; repeated rows are one document; rows with equal doc_id and
different texts are handled apart; an empty table gives no rows; texts of any length are read
whole; other columns are passed on by the removal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.common import fresh, id_bitmap, in_bitmap, lean, ship, table_cut, tiles
from millrace.llm.components import components
from millrace.llm.lattice import _forest
from millrace.llm.near_dup import compare_sets, link_by_stars

MIN_WORDS = 24
SHINGLE = 5
BANDS = 8
#: Words beyond which a line is cut into segments as well, and sentences on either side among which a cut is the least.
LONG_LINE, AROUND = 160, 3
#: Words that two texts share at least, and length of the runs of which one lies in any such words.
SHARED, RUN = 51, 32
#: Sets of a tile that a value is held by from which on it is counted by a product of matrices, and columns of a matrix.
MANY, WIDE = 16, 4096
#: Bits of the bitmap of common keys: 16 MB whatever the input size.
KEY_BITS = 1 << 27
_R = 0xC2B2AE3D27D4EB4F
_R_INVERSE = pow(_R, -1, 1 << 64)
#: Words up to which a sum tells runs apart; longer ones have a digest each.
LONG_RUN = 256
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
_BAND = np.random.default_rng(613).integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out, out=out)


@dataclass
class _Sums:
    """What hashes of runs of a block's words are taken from."""

    words: np.ndarray  #: hashes of the words
    total: np.ndarray  #: running sum of the words' hashes times powers
    inverse: np.ndarray

    def runs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the words from first to before last."""
        with np.errstate(over="ignore"):
            out = W.mix((self.total[last] - self.total[first]) * self.inverse[first] + (last - first).astype(np.uint64))
        for i in np.flatnonzero(last - first > LONG_RUN).tolist():
            out[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(self.words[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little"))
        return out


def _sums(w: W.Words) -> _Sums:
    n = len(w.hash)
    with np.errstate(over="ignore"):
        return _Sums(w.hash, np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * _powers(_R, n))]), _powers(_R_INVERSE, n + 1))


def _sliding(x: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """``of`` (minimum or maximum) of each ``size`` values in a row."""
    span = 1
    while span < size:
        step = min(span, size - span)
        x = of(x[:-step], x[step:])
        span += step
    return x


def anchored(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each winnowed run of RUN words of a block: first word, word after it, and hash of its words."""
    n, window = len(w.start), SHARED - RUN + 1
    if n < SHARED:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    sums = _sums(w)
    p = np.arange(n - RUN + 1)
    h = sums.runs(p, p + SHINGLE)
    least = _sliding(h, window, np.minimum)
    doc_end = np.repeat(w.bounds[1:], np.diff(w.bounds))
    least[p[: len(least)] + SHARED > doc_end[: len(least)]] = 0  # reaches into the next text
    # A start is chosen if it is least in some window that holds it.
    chosen = h <= _sliding(np.pad(least, window - 1), window, np.maximum)
    a = np.flatnonzero(chosen & (p + RUN <= doc_end[: len(p)]))
    return a, a + RUN, sums.runs(a, a + RUN)


def paragraphs(w: W.Words, bands: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each paragraph of a block: first word, word after it, hash of its words, and BANDS band keys."""
    n = len(w.start)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, np.zeros(0, np.uint64), np.zeros((0, BANDS), np.uint64)
    sums = _sums(w)
    line_last = np.zeros(n, dtype=bool)
    line_last[w.bounds[1:][np.diff(w.bounds) > 0] - 1] = True
    lines = np.concatenate([[0], np.cumsum(w.data == 10)])
    line_last[:-1] |= lines[w.start[1:]] > lines[w.end[:-1]]
    b = np.flatnonzero(line_last) + 1
    a = np.concatenate([[0], b[:-1]])
    long = b - a > LONG_LINE
    keep = b - a >= MIN_WORDS
    parts = [np.stack([a[keep], b[keep]], axis=1)]
    if long.any():
        # The sentences of long lines: a cut before each that has the least hash around it.
        last = np.flatnonzero(line_last | _STOP[w.data[w.end - 1]]) + 1
        first = np.concatenate([[0], last[:-1]])
        line = np.searchsorted(b, first, "right")
        on = long[line]
        first, last, line = first[on], last[on], line[on]
        h = np.pad(sums.runs(first, last), AROUND, constant_values=np.uint64(2**64 - 1))
        cut = h[AROUND : AROUND + len(first)] <= _sliding(h, 2 * AROUND + 1, np.minimum)
        cut[0] = True
        cut[1:] |= line[1:] != line[:-1]
        at = np.flatnonzero(cut)
        part = np.stack([first[at], last[np.append(at[1:], len(first)) - 1]], axis=1)
        parts.append(part[part[:, 1] - part[:, 0] >= MIN_WORDS])
    ab = np.unique(np.concatenate(parts), axis=0)
    a, b = ab[:, 0], ab[:, 1]
    keys = np.zeros((len(a), BANDS), np.uint64)
    if len(a) and bands:
        p = np.arange(n - SHINGLE + 1)
        shingle = np.append(sums.runs(p, p + SHINGLE), np.uint64(0))
        cuts = np.stack([a, b - SHINGLE + 1], axis=1).ravel()
        with np.errstate(over="ignore"):
            for k in range(BANDS):
                keys[:, k] = np.minimum.reduceat(W.mix(shingle * _BAND[k]), cuts)[::2]
            keys = W.mix(keys * np.uint64(_R) + np.roll(keys, -1, axis=1) + np.arange(BANDS, dtype=np.uint64))
    return a, b, sums.runs(a, b), keys


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys and hashes of word runs, and 2 for those of several texts of the batch, else 1: runs of one text overlap and share keys, which counts once."""
    for b in batches:
        found = []
        for w in W.blocks(b.column(0)):
            first, _, _, keys = paragraphs(w)
            start, _, run = anchored(w)
            row = np.searchsorted(w.bounds, np.concatenate([np.repeat(first, BANDS), start]), "right") - 1
            flat = np.concatenate([keys.ravel(), run])
            order = np.lexsort((flat, row))
            row, flat = row[order], flat[order]
            new = np.ones(len(flat), bool)
            new[1:] = (row[1:] != row[:-1]) | (flat[1:] != flat[:-1])
            found.append(flat[new])
        key, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        for i in range(0, len(key), 50_000):
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[i : i + 50_000].view(np.int64)), "n": pa.array(np.minimum(n[i : i + 50_000], 2).astype(np.int8))})


def _grouped(row: np.ndarray, full: np.ndarray, a: np.ndarray, b: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paragraphs of one text with equal words as one: a paragraph of each, not a ``bare`` one if there are others, bounds of its spans, and the spans, those that overlap as one."""
    order = np.lexsort((a, full, row))
    row, full, a, b = row[order], full[order], a[order], b[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (full[1:] != full[:-1])
    group = np.cumsum(new) - 1
    reach = np.maximum.accumulate(b + group * (int(b.max(initial=0)) + 1)) - group * (int(b.max(initial=0)) + 1)
    cut = new.copy()
    cut[1:] |= a[1:] > reach[:-1]
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], len(row)) - 1
    first = np.flatnonzero(new)
    unit = order[np.minimum.reduceat(np.arange(len(row)) + len(row) * bare[order], first) % len(row)] if len(row) else order
    return unit, np.append(np.searchsorted(at, first), len(at)), a[at], reach[ends] if len(at) else reach


def _occurrences(common: np.ndarray) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = batch.column(0), batch.column(1)
            for w in W.blocks(batch.column(2)):
                found, runs = paragraphs(w), anchored(w)
                keys = found[3]
                hit = in_bitmap(common, keys.ravel().view(np.int64)).reshape(-1, BANDS)
                on, on_run = np.flatnonzero(hit.any(1)), np.flatnonzero(in_bitmap(common, runs[2].view(np.int64)))
                a, b, full = (np.concatenate([x[on], y[on_run]]) for x, y in zip(found, runs, strict=False))
                none = np.zeros((len(on_run), BANDS), np.uint64)  # a run has no bands
                keys, hit = np.concatenate([keys[on], none]), np.concatenate([hit[on], none > 0])
                row = np.searchsorted(w.bounds, a, "right") - 1
                base = w.offsets[row]
                unit, bounds, start, end = _grouped(row, full, w.start[a] - base, w.end[b - 1] - base, ~hit.any(1))
                where = pa.array(row[unit] + w.first)
                ends = pa.array(bounds, pa.int32())
                on_keys = hit[unit]
                ends_of_keys = pa.array(np.concatenate([[0], np.cumsum(on_keys.sum(1))]), pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(full[unit].view(np.int64)), "doc_id": ids.take(where), "print": prints.take(where), "keys": pa.ListArray.from_arrays(ends_of_keys, pa.array(keys[unit][on_keys].view(np.int64))),
                    "starts": pa.ListArray.from_arrays(ends, pa.array(start)), "ends": pa.ListArray.from_arrays(ends, pa.array(end)),
                })

    return rows


def _unit_sets(wanted: np.ndarray) -> Callable:
    """The shingle sets of the paragraphs whose hash may be wanted, each once for a block: 32-bit hashes, which among the few shingles of two paragraphs differ but for one pair in a million."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.blocks(batch.column(0)):
                a, b, full, _ = paragraphs(w, bands=False)
                on = np.flatnonzero(in_bitmap(wanted, full.view(np.int64)))
                ids, first = np.unique(full[on], return_index=True)
                if not len(ids):
                    continue
                p = np.arange(len(w.hash) - SHINGLE + 1)
                shingle = (_sums(w).runs(p, p + SHINGLE) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                sets = [np.unique(shingle[x : y - SHINGLE + 1]) for x, y in zip(a[on][first], b[on][first], strict=True)]
                n = np.array([len(x) for x in sets], np.int64)
                bounds = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.RecordBatch.from_pydict({"s_id": pa.array(ids.view(np.int64)), "s_n": pa.array(n), "s_set": pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(sets).view(np.int32)))})

    return rows


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets have in common, as a matrix."""
    n, size = len(sets), [len(x) for x in sets]
    values, which = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    held = np.bincount(which, minlength=len(values))
    # Common values by a product of matrices, of which the width is bounded by the sets' sizes; rare ones by their pairs.
    common = np.flatnonzero(held >= MANY)
    number = np.full(len(values), -1)
    number[common] = np.arange(len(common))
    out = np.zeros((n, n), np.float32)
    on = number[which] >= 0
    for part in range(0, len(common), WIDE):
        here = on & (number[which] >= part) & (number[which] < part + WIDE)
        m = np.zeros((n, min(WIDE, len(common) - part)), np.float32)
        m[row[here], number[which[here]] - part] = 1
        out += m @ m.T
    rare = np.flatnonzero(~on & (held[which] > 1))
    rare = rare[np.argsort(which[rare], kind="stable")]
    v, r = which[rare], row[rare]
    flat = out.ravel()
    for step in range(1, MANY):  # the holders of a value that are `step` apart in its list
        same = np.flatnonzero(v[step:] == v[:-step])
        if not len(same):
            break
        pairs = np.concatenate([r[same] * n + r[same + step], r[same + step] * n + r[same]])
        flat += np.bincount(pairs, minlength=n * n).astype(np.float32)
    return out


def _tile_links(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked in a tile and isn't in one component already."""
    at, chunk = rows["at"].to_numpy(), rows["chunk"].to_numpy()
    cross = rows["lo"][0].as_py() < rows["hi"][0].as_py()
    none = np.zeros(0, np.int64)
    if len(at) < 2 or (at == at[0]).all() or cross and (chunk == chunk[0]).all():
        return none, none
    ids, lists = rows["id"].to_numpy(), rows["s_set"].combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    both = _overlaps(np.split(lists.flatten().to_numpy(), np.cumsum(size)[:-1]))
    i, j = np.nonzero(100 * both >= percent * (size[:, None] + size[None, :] - both))
    on = (i < j) & (at[i] != at[j])
    # One link for each two components that a tile connects will do.
    name, number = np.unique(at, return_inverse=True)
    _, first = np.unique(np.minimum(number[i[on]], number[j[on]]) * len(name) + np.maximum(number[i[on]], number[j[on]]), return_index=True)
    i, j = i[on][first], j[on][first]
    low = _forest(len(name), number[i], number[j])
    # A member of each component and one of the component's root: a link of the forest.
    member = np.zeros(len(name), np.int64)
    member[number] = ids
    moved = np.flatnonzero(low != np.arange(len(name)))
    return member[moved], member[low[moved]]


def _forests(percent: int) -> Callable:
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and tile; a tile is held whole, and its size is bounded."""
        for tile in tiles(batches, 3):
            a, b = _tile_links(tile, percent)
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return link


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, a print of the text, and the text: what tells rows apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))


def find_repeats(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Every paragraph to remove: ``doc_id, print, a, b`` (bytes of the text), its cluster, and the first document with it."""
    ship(docs.sparkSession)
    rows = _texts(docs)
    counts = rows.select("text").mapInArrow(lean(_key_counts), "key long, n byte")
    common = table_cut(counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("key").alias("k_key")), "common")
    # The bitmap only spares shuffling keys that come once; the join is exact.
    found = rows.mapInArrow(lean(_occurrences(id_bitmap(common, "k_key", KEY_BITS))), "id long, doc_id long, print long, keys array<long>, starts array<long>, ends array<long>")
    occurrence = table_cut(found, "occurrences")
    keyed = occurrence.select("id", F.explode("keys").alias("key")).distinct().join(common, F.col("key") == F.col("k_key"), "left_semi")
    keyed = table_cut(keyed, "keyed")
    centre = keyed.groupBy("key").agg(F.min("id").alias("c_id"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("c_key"), "c_id", "n")
    met = table_cut(keyed.join(centre, F.col("key") == F.col("c_key")).select("key", "id", "c_id", "n"), "met")
    # The bitmap only spares making sets that no pair needs; the joins with the sets are exact.
    sets = rows.select("text").mapInArrow(lean(_unit_sets(id_bitmap(met.select("id").distinct(), "id"))), "s_id long, s_n long, s_set array<int>")
    sets = table_cut(sets.dropDuplicates(["s_id"]), "sets")

    def forest(rows: DataFrame) -> DataFrame:
        held = rows.join(sets.select("s_id", "s_set"), F.col("id") == F.col("s_id")).select("key", "lo", "hi", "chunk", "id", "at", "s_set")
        return held.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(lean(_forests(percent)), "a long, b long")

    links = link_by_stars(met, lambda pairs: compare_sets(pairs, sets, percent), larger=met.where("n > 2"), forest=forest)
    of = components(links).select(F.col("node").alias("f_id"), "component")
    unit = occurrence.join(of, F.col("id") == F.col("f_id"), "left").select("doc_id", "print", "starts", "ends", F.coalesce("component", "id").alias("cluster"))
    # The first text with the passage: partial aggregation, however common a passage is.
    first = unit.groupBy("cluster").agg(F.min(F.struct("doc_id", "print")).alias("first"), F.max(F.struct("doc_id", "print")).alias("last")).where("first <> last").select(F.col("cluster").alias("c_cluster"), "first")
    gone = unit.join(first, F.col("cluster") == F.col("c_cluster")).where(F.struct("doc_id", "print") != F.col("first"))
    gone = gone.select("doc_id", "print", "cluster", F.col("first.doc_id").alias("first_doc_id"), F.explode(F.arrays_zip("starts", "ends")).alias("s"))
    return gone.select("doc_id", "print", F.col("s.starts").alias("a"), F.col("s.ends").alias("b"), "cluster", "first_doc_id")


def merged(repeats: DataFrame) -> DataFrame:
    """Spans to cut, without overlaps: ``doc_id, print, start, end`` in bytes, and the clusters and first documents that they hold."""
    w = Window.partitionBy("doc_id", "print").orderBy("a", "b", "cluster")
    rows = repeats.withColumn("reach", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("span", F.sum(F.when(F.col("a") <= F.col("reach"), 0).otherwise(1)).over(w))
    out = rows.groupBy("doc_id", "print", "span").agg(F.min("a").alias("start"), F.max("b").alias("end"), F.min("cluster").alias("cluster"), F.min("first_doc_id").alias("first_doc_id"), F.count("*").alias("n_paragraphs"))
    return out.drop("span")


def _cutter(text_at: int, cuts_at: int, chars_at: int | None) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_at).to_pylist()
            for i, spans in enumerate(b.column(cuts_at).to_pylist()):
                if spans:
                    data, parts, at = texts[i].encode(), [], 0
                    for s in sorted(spans, key=lambda s: s["start"]):
                        parts.append(data[at : s["start"]])
                        at = s["end"]
                    parts.append(data[at:])
                    texts[i] = "\n".join(p for p in (x.decode().strip() for x in parts) if p)
            columns = [b.column(k) for k in range(b.num_columns) if k != cuts_at]
            columns[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                old = columns[chars_at]
                n = [len(t) if spans else o for t, spans, o in zip(texts, b.column(cuts_at).to_pylist(), old.to_pylist(), strict=True)]
                columns[chars_at] = pa.array(n, old.type)
            yield pa.RecordBatch.from_arrays(columns, names=[b.schema.names[k] for k in range(b.num_columns) if k != cuts_at])

    return cut


def remove_repeats(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated passages cut from ``text`` (and ``n_chars`` counted anew where it was cut)."""
    doc, mark, cuts = fresh(docs, "cut_doc", "cut_print", "cuts")
    spans = merged(find_repeats(docs, percent)).groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", "end")).alias(cuts)).select(F.col("doc_id").alias(doc), F.col("print").alias(mark), cuts)
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    joined = docs.join(table_cut(spans, "spans"), (own_id == F.col(doc)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(mark)), "left").drop(doc, mark)
    at = docs.columns.index
    return joined.mapInArrow(_cutter(at("text"), len(docs.columns), at("n_chars") if "n_chars" in docs.columns else None), docs.schema)
