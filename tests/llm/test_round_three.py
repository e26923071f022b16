"""Sort-means, packing by concatenation and spelling variants: against brute force, with awkward rows and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import sort_means, spelling, stream_packing
from millrace.llm.queries import vocabulary
from millrace.llm.tokens import WordTokenizer

WORDS = vocabulary("word_bpe_49k.json")


# sort-means


def lloyd(rows, k, rounds, dim):
    """Every distance, in Python's whole numbers."""
    v = [(i, [int(np.floor(256.0 * x)) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) and abs(256 * x) < 1 << 27 for x in e)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in v if i is not None)[:k]
    c = [x for _, x in first]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        got = [min((square(x, y), j) for j, y in enumerate(c)) for _, x in v]
        if turn == rounds:
            break
        for j in range(len(c)):
            mine = [x for (_, x), (_, g) in zip(v, got, strict=True) if g == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    inertia = Counter()
    for d, j in got:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(repr((i, j, d, inertia[j], sum(inertia.values()), sha[j])) for (i, _), (d, j) in zip(v, got, strict=True))


def vectors(seed, n, dim, grid):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [round((x + rng.gauss(0, 0.2)) * grid) / grid for x in rng.choice(centres)]) for i in range(n)]
    return rows + [(3, rows[3][1]), (4, rows[5][1]), (None, rows[6][1]), (900, None), (901, []), (902, [0.0] * (dim - 1)), (903, [None] + [0.5] * (dim - 1)), (904, [float("nan")] * dim), (905, [float("inf")] * dim), (906, [0.0] * dim), (907, [1e30] * dim)]


@pytest.mark.parametrize("seed,grid,kind", [(1, 64, "double"), (2, 1, "float"), (3, 2, "double")])  # a coarse grid makes ties
def test_sort_means_against_all_distances(spark, seed, grid, kind):
    rows = vectors(seed, 150, 8, grid)
    df = spark.createDataFrame([(i, e, 1, "c", 2) for i, e in rows], f"vec_id long, embedding array<{kind}>, cluster int, v string, n int").repartition(5)
    got = sort_means.cluster_vectors(df, k=12, rounds=4, dim=8)
    assert sorted(repr(tuple(r)) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == lloyd(rows, 12, 4, 8)


def test_sort_means_with_few_vectors_none_and_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    assert sort_means.cluster_vectors(spark.createDataFrame([], schema), dim=2).count() == 0
    assert sort_means.cluster_vectors(spark.createDataFrame([(None, [1.0, 2.0])], schema), dim=2).count() == 0  # nothing can start a centroid
    rows = [(1, [400_000.0, -400_000.0]), (2, [-400_000.5, 0.25]), (3, [400_000.0, -399_999.0])]
    got = sort_means.cluster_vectors(spark.createDataFrame(rows, schema), k=2, rounds=3, dim=2).collect()
    assert sorted(repr(tuple(r)) for r in got) == lloyd(rows, 2, 3, 2)


def test_scans_stop_early_and_lose_nothing():
    rng = np.random.default_rng(7)
    centroids = rng.integers(-200, 200, (30, 16))
    x = np.concatenate([centroids[rng.integers(0, 30, 800)] + rng.integers(-20, 20, (800, 16)), rng.integers(-200, 200, (200, 16))])
    d = ((x[:, None] - centroids[None]) ** 2).sum(2)
    best = d.argmin(1)  # the first of equal ones
    for before in (np.zeros(1000, np.int32), best.astype(np.int32), rng.integers(0, 30, 1000).astype(np.int32)):
        who, near, taken = sort_means.assign(x, before, centroids)
        assert (who == best).all() and (near == d.min(1)).all()
    assert sort_means.assign(x[:800], best[:800].astype(np.int32), centroids)[2] < 0.2 * 800 * 30
    # At exactly twice the distance a centroid can tie, and the smaller number wins.
    line = np.array([[4], [0]])
    assert sort_means.assign(np.array([[2]]), np.array([1], np.int32), line)[0].tolist() == [0]


# packing by concatenation


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "p") for i, t in rows], "doc_id long, text string, part int, at int, ids string")


def test_concatenation_against_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["Alpha", "beta,", "it's", "naïve", "x"]) for _ in range(rng.randint(0, 200)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "y " * 3000), (5, rows[5][1]), (None, "nobody"), (83, "<|endoftext|> two  spaces\n\n")]
    out = stream_packing.concatenate(documents(spark, rows).repartition(6), WORDS, capacity=64)
    got = out.collect()
    ids = Counter()
    for d, t in rows:
        ids[(d, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2]))] += 1
    by, total = {}, sum(len(x) * n for (_, x), n in ids.items())
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        piece = np.frombuffer(r.ids, "<u4")
        assert len(piece) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        assert any(d == r.doc_id and len(x) == r.doc_tokens and list(x[r.start : r.start + r.length]) == piece.tolist() for d, x in ids)
    assert sum(r.length for r in got) == total
    # Each id lies in one piece: the pieces of each document, in order, cover it as often as it comes.
    cover = Counter((r.doc_id, r.doc_tokens, r.start + k) for r in got for k in range(r.length))
    want = Counter()
    for (d, x), n in ids.items():
        for k in range(len(x)):
            want[(d, len(x), k)] += n
    assert cover == want
    sizes = []
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        sizes.append(at)
    assert sorted(by) == list(range(len(by))) and sizes.count(64) >= total // 64 and all(s & (s - 1) == 0 for s in sizes)  # no sequence needs padding
    whole = stream_packing.sequences(out).collect()
    assert sorted((r.n_tokens, r.n_pieces, len(r.ids)) for r in whole) == sorted((sum(n for _, n in p), len(p), 4 * sum(n for _, n in p)) for p in by.values())
    assert stream_packing.concatenate(documents(spark, []), WORDS).count() == 0


def test_last_cuts():
    assert stream_packing.last_cuts(4096 * 3 + 13, 4096) == [4096 * 3 + 8, 4096 * 3 + 12, 4096 * 3 + 13]
    assert stream_packing.last_cuts(4096, 4096) == [] and stream_packing.last_cuts(2, 4096) == [2]


def test_memo_of_a_vocabulary_that_drops_white_space():
    tok, rng = WordTokenizer(WORDS), random.Random(1)
    assert tok.spaceless
    alphabet = [*"aAbé.,'’sS tTd\n\t  \r-#()É́İΣß×<|>!01٣  \x1c\u0085ññ", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "<|END", "straße", "≠", ";;", "a" * 50]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for _ in range(2):  # the second time from the memo
        ids, bounds = tok.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tok.library.encode(t, add_special_tokens=False).ids


# spelling variants


def spelled(rows, least=7, often=2, one_in=31, ratio=10):
    """All pairs, by the definition."""
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least and n >= often}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [v for v in words if v != w and near(v, w)] for w in words}
    form = {}
    for w, vs in by.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(repr((w, form[w], root(w), n, len(by[w]), words.get(form[w]))) for w, n in words.items())


def spelling_rows(seed):
    rng = random.Random(seed)
    stems = ["mountain", "straßenbahn", "château", "señoritas", "windows", "aaaaaaa", "über×÷ñ", "reading", "abcdefg", "Ärgernis"]
    words = []
    for s in stems:
        words += [s] * 300
        for _ in range(30):
            w = list(s)
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[at : at + 1] = [[], [rng.choice("abesñÀ")], [w[at], rng.choice("abesñ")]][kind]
            words += ["".join(w)] * rng.choice([1, 2, 5, 40])
    rng.shuffle(words)
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words[k : k + 50]) + rng.choice([".", "1", "-", ""])) for i, k in enumerate(range(0, len(words), 50))]
    return [*rows, (7, rows[7][1]), (None, "mountain reading"), (1000, None), (1001, ""), (1002, "z" * 5000 + " " + "z" * 5000), (1003, "é" * 90 + " " + "é" * 91 + " " + "é" * 90 + " " + "é" * 91)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_against_all_pairs(spark, seed):
    rows = spelling_rows(seed)
    df = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in rows], "doc_id long, text string, word string, n int, key string").repartition(5)
    got = spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(repr(tuple(r)) for r in got) == spelled(rows)


def test_forms_that_lead_on_and_nothing_to_do(spark):
    rows = [(i, t) for i, t in enumerate(["aaaaaaaa " * 3000, "aaaaaaab " * 200, "aaaaaacb " * 20, "aaaaadcb " * 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r for r in spelling.variants(df, drop_one_in=0).collect()}
    assert got["aaaaadcb"].form == "aaaaaacb" and {r.root for r in got.values()} == {"aaaaaaaa"} and got["aaaaaaaa"].form is None
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crc_of_many_runs_at_once():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4800, 300)
    end = start + rng.integers(0, 150, 300)
    before = np.array([zlib.crc32(str(i).encode()) for i in range(300)], np.uint32)
    got = spelling.crc32_from(before, data, start, end)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(start, end, before, strict=True)]


def test_variants_of_a_hot_group_meet_few_others(spark):
    """Words with one ending and one set of letters share bands; the halves keep candidates near the number of words."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcd") for _ in range(8)) + "tion" for _ in range(4000)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    pairs = {(r.a, r.b) for r in spelling.near_words(df).collect()}
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    want = {(min(a, b), max(a, b)) for ws in holes.values() for a in ws for b in ws if a != b}
    assert pairs == want
