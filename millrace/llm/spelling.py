"""Spelling variants of the words of a corpus, by bands of letter parities.

A word's mask has a bit for each letter: whether the letter comes an odd number of times. One inserted or deleted letter turns one bit,
one replaced letter two, so of three bands of the mask one at least stays equal: words meet where a band is
equal, with lengths that differ by one at most. So that a band's bucket doesn't grow with the square of
the vocabulary, it is split further by what one edit can't touch at once: for words whose shorter one has m letters,
either the first m // 2 letters or the last m - m // 2 are the same. Pairs that meet are verified by edit distance. No pair of near words is lost, whatever the bucket.

Words are counted within each batch, then within a task, then over the corpus; only distinct words go further.

Defined results: a null or empty text has no runs; a null doc_id counts as an empty one where letters are dropped; repeated rows count
as often as they come; runs of any length are words like others; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.common import lean, ship, table_cut

MIN_CHARS, MIN_COUNT, DROP_ONE_IN, RATIO = 7, 2, 31, 10
#: Letters: a to z and U+00C0 to U+00FF, dealt to the bands in turn.
LETTERS, BANDS = 26 + 64, 3
_LEAD = 0xC3  # in UTF-8 the first byte of U+00C0 to U+00FF, and of nothing else
_ASCII = np.zeros(256, dtype=bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
#: Bytes up to which runs are hashed along with others.
_LONG = 64


def _crc_steps() -> np.ndarray:
    """What a byte does to a CRC-32."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def crc32_from(before: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each data[start:end], continued from the CRC-32 ``before`` it; all of a batch at once."""
    step, size = _crc_steps(), end - start
    out = np.zeros(len(start), np.uint32)
    for i in np.flatnonzero(size > _LONG):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    short = np.flatnonzero(size <= _LONG)
    short = short[np.argsort(-size[short], kind="stable")]
    h, at, n = ~before[short].astype(np.uint32), start[short], size[short]
    for k in range(int(n[0]) if len(n) else 0):
        on = int(np.searchsorted(-n, -k, "left"))  # those with more than k bytes
        h[:on] = step[(h[:on] ^ data[at[:on] + k]) & np.uint32(255)] ^ (h[:on] >> np.uint32(8))
    out[short] = ~h
    return out


def _counter(min_chars: int, one_in: int) -> Callable:
    def counted(ids: list, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        data = W._LOWER[data]
        lead = data == _LEAD
        inside = _ASCII[data] | lead
        inside[1:] |= lead[:-1]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        opens[edges], closes[edges - 1] = inside[edges], inside[edges - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        leads = np.concatenate([[0], np.cumsum(lead)])
        chars = end - start - (leads[end] - leads[start])
        on = chars >= min_chars
        start, end, chars = start[on], end[on], chars[on]
        doc = np.searchsorted(offsets, start, "right") - 1
        before = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids], np.uint32)
        h = crc32_from(before[doc], data, start, end) if one_in else np.ones(len(start), np.uint32)
        cut = h % one_in == 0 if one_in else np.zeros(len(start), bool)
        changed = []
        for i in np.flatnonzero(cut):
            if chars[i] > min_chars:
                run = data[start[i] : end[i]].tobytes().decode()
                place = int(h[i]) % len(run)
                changed.append(run[:place] + run[place + 1 :])
        start, end = start[~cut], end[~cut]
        # Runs and what is between them in turn, over the same bytes.
        bounds = np.stack([start, end], 1).reshape(-1)
        every = pa.LargeStringArray.from_buffers(max(0, len(bounds) - 1), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))
        found = pa.concat_arrays([every.take(pa.array(np.arange(len(start)) * 2)), pa.array(changed, pa.large_string())]).value_counts()
        return pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1).cast(pa.int64())], names=["word", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = W.raw(b.column(1))
            ids, row = b.column(0).to_pylist(), 0
            while row < len(ids):
                to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + W.BLOCK_BYTES, "right")) - 1)
                if offsets[to] > offsets[row]:
                    yield counted(ids[row:to], data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
                row = to

    return rows


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """``word, n``: runs of letters with A-Z lower-cased, of at least ``min_chars``, that come at least ``min_count`` times.

    Where the CRC-32 of ``<doc_id>:<run>`` is divisible by ``drop_one_in`` (0: never), the run loses the letter at that number modulo its length.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(lean(_counter(min_chars, drop_one_in)), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def masks(words: list[str]) -> np.ndarray:
    """The bands of each word's mask, by word and band; letter i is bit i // BANDS of band i % BANDS."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    letters = np.where(letters < 128, letters - 97, letters - 0xC0 + 26)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    odd = np.bincount(row * LETTERS + letters, minlength=len(words) * LETTERS).reshape(-1, LETTERS) & 1
    out = np.zeros((len(words), BANDS), np.int64)
    for i in range(LETTERS):
        out[:, i % BANDS] |= odd[:, i].astype(np.int64) << (i // BANDS)
    return out


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        m = masks(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(m[:, i]) for i in range(BANDS))], names=["word", "n", *(f"m{i}" for i in range(BANDS))])


def near_words(words: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b`` for the pairs of distinct words of ``word, n`` that differ by one inserted, deleted or replaced letter; one row for each pair.

    A word goes out under the keys of its own length, where it meets equally long words and those with one letter more,
    and those under the keys of the length below. Of a pair of different lengths two bands are equal, so one of the first two is enough.
    """
    rows = words.mapInArrow(lean(_masked), "word string, n long, " + ", ".join(f"m{i} long" for i in range(BANDS)))
    size = F.length("word")

    def keys(m: Column, bands: int) -> Column:
        """For a shorter word of ``m`` letters. Hashes of 40 bits: what they bring together by chance falls at the verification."""
        half = F.floor(m / 2).cast("int")
        sides = (F.substring(F.col("word"), F.lit(1), half), F.col("word").substr(size - (m - half) + 1, m - half))
        return F.array(*[F.shiftrightunsigned(F.xxhash64(m, F.lit(side), F.lit(i), F.col(f"m{i}"), part), 24) for side, part in enumerate(sides) for i in range(bands)])

    def keyed(name: str, k: Column) -> DataFrame:
        return rows.select(F.explode(k).alias(f"{name}_key"), F.col("word").alias(f"{name}_word"), F.col("n").alias(f"{name}_n"))

    x, y = keyed("x", keys(size, BANDS)), keyed("y", F.concat(keys(size, BANDS), keys(size - 1, 2)))
    more = F.length("y_word") - F.length("x_word")
    pairs = x.join(y, (F.col("x_key") == F.col("y_key")) & ((more == 1) | (more == 0) & (F.col("x_word") < F.col("y_word")))).where(F.levenshtein("x_word", "y_word", 1) == 1)
    return pairs.select(F.col("x_word").alias("a"), F.col("y_word").alias("b"), F.col("x_n").alias("n_a"), F.col("y_n").alias("n_b")).distinct()


def _roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """``r_word, root`` of ``word, form``: where the forms end. Each step multiplies n by ``ratio`` at least, so the largest n bounds the steps; each round doubles them."""
    at = forms.select(F.col("word").alias("r_word"), F.col("form").alias("root"))
    steps, reach = 1, most
    while reach >= ratio:
        steps, reach = steps + 1, reach // ratio
    while steps > 1:
        at = table_cut(at, "roots")
        on = at.select(F.col("r_word").alias("o_word"), F.col("root").alias("o_root"))
        at = at.join(on, F.col("root") == F.col("o_word"), "left").select("r_word", F.coalesce("o_root", "root").alias("root"))
        steps = -(-steps // 2)
    return at


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, drop_one_in: int = DROP_ONE_IN, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: each word with its near word of largest n, if that is ``ratio`` times its own, and where such forms lead."""
    words = table_cut(word_counts(docs, min_chars, min_count, drop_one_in), "words")
    pairs = table_cut(near_words(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))
    best = both.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("minus_n"), F.col("b").alias("word"))).alias("best"))
    enough = -F.col("best.minus_n") >= ratio * F.col("n")
    rows = words.join(best, F.col("word") == F.col("a"), "left").select(
        "word", F.when(enough, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.minus_n")).alias("form_n")
    )
    rows = table_cut(rows, "forms")
    most = words.agg(F.max("n")).first()[0] or 0
    roots = _roots(rows.where("form is not null"), most, ratio)
    return rows.join(roots, F.col("word") == F.col("r_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
