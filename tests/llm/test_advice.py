"""Places where an operator did less than the whole job."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import near_dup, substring_dedup
from millrace.llm import words as W


def test_fine_bits_of_small_sets_are_even():
    rng = np.random.default_rng(5)
    for n in (10, 15, 30, 60):
        for _ in range(40):
            u = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            bits = [W.mix(near_dup.signature(x, near_dup.FINE_BITS) * near_dup._odd(near_dup.FINE_BITS)) & np.uint64(1) for x in (u, u[n // 5 :])]
            assert (bits[0] != bits[1]).sum() <= near_dup.FINE_MISSES


def test_small_sets_are_not_ruled_out_by_sketches(spark):
    """Pairs of similarity 0.8 in one bucket whose centre is another text: only the last comparison finds them."""
    rng = random.Random(3)
    texts, want = ["centre of all"], []
    for words in (6, 16, 31, 51, 76):
        for _ in range(12):
            w = [f"v{rng.randrange(10**9)}" for _ in range(words)]
            want.append((len(texts), len(texts) + 1))
            texts += [" ".join(w), " ".join(w[: len(w) - (len(w) - 1) // 5])]
    rows = spark.createDataFrame(list(enumerate(texts)), "d_id long, text string")
    met = spark.createDataFrame([(1, i, 0) for i in range(len(texts))], "key long, id long, c_id long")
    sets = near_dup._sets_of(rows, met.select("id"), 2)
    signed = rows.mapInArrow(near_dup._signer(2), "doc_id long, n_shingles long, set_hash long, keys array<long>, sketch array<long>")
    looks = signed.select(F.col("doc_id").alias("k_id"), F.col("n_shingles").alias("n"), "sketch")
    links = near_dup.link_by_stars(met, lambda p: near_dup.compare_sets(p, sets, 80), looks, lambda x, y: near_dup._near(x, y, 80), near_dup._fine_looks(sets, 80), lambda x, y: near_dup._finely_near(x, y, 80))
    assert sorted((r.a, r.b) for r in links.collect()) == want


def _words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_any_shared_words_hold_a_run():
    rng = random.Random(8)
    for n, at_least in ((substring_dedup.SHARED, 1), (substring_dedup.SHARED - 1, 0), (300, 10)):
        for _ in range(30):
            shared = _words(rng, n)
            texts = [" ".join(_words(rng, rng.randrange(90)) + shared + _words(rng, rng.randrange(90))) for _ in range(2)]
            runs = [set(substring_dedup.anchored(next(W.blocks(pa.array([t]))))[2].tolist()) for t in texts]
            assert len(runs[0] & runs[1]) >= at_least
    two = next(W.blocks(pa.array([" ".join(_words(rng, 30)), " ".join(_words(rng, 30)), "x " * 400, None])))
    a, b, _ = substring_dedup.anchored(two)
    assert len(a) and a.min() >= 60 and b.max() <= 460


def test_passages_inside_sentences_are_removed(spark):
    """Shared passages that start and end inside a sentence, and text without any sentence."""
    rng = random.Random(9)
    say = lambda *n: " ".join(" ".join(_words(rng, k)) + "." for k in n)
    passages = [say(20, 20, 20)[:-1], say(40, 45)[:-1], " ".join(_words(rng, 60)), " ".join(_words(rng, 51))]
    texts = []
    for _ in range(2):
        texts += [" ".join(_words(rng, 17)) + f" {p} " + " ".join(_words(rng, 19)) for p in passages]
    rows = [(i, t, len(t)) for i, t in enumerate(texts)]
    out = {r.doc_id: r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect()}
    for i, p in enumerate(passages):
        assert out[i] == texts[i]
        left, own = set(out[i + 4].split()), set(texts[i + 4].split()) - set(p.split())
        assert own <= left and len(left & set(p.split())) <= len(p.split()) - substring_dedup.RUN


def test_edited_passages_apart_from_the_centre_are_linked(spark):
    """Variants of boilerplate that share buckets, in pairs of edited copies: no pair may depend on who is the centre."""
    rng = random.Random(21)
    base, rows, want = _words(rng, 60), [], []
    for v in range(120):
        own = list(base)
        own[20:23] = _words(rng, 3)  # similarity 0.78 to other variants
        edited = list(own)
        edited[rng.choice([2, 57])] = "edited"
        want.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(edited))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for _, t in rows]
    assert all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in want)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.find_repeats(df).where(f"a = 0 and b >= {min(len(t.encode()) for _, t in rows)}")
    got = {(r.first_doc_id, r.doc_id) for r in found.collect()}
    assert len(got & set(want)) >= 118  # a pair shares no bucket with probability below 0.001
