"""Whole results against brute force, awkward rows, and columns whose names operators use themselves."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import html_extract, mixing, near_dup, packing, quality, substring_dedup, token_files, toxicity
from millrace.llm import words as W
from millrace.llm.queries import vocabulary
from millrace.llm.tokens import WordTokenizer
from millrace.storage import table_cut

NAMES = ("t_class", "p_slot", "gone_id", "mr_doc", "mr_cuts", "cuts", "cut_doc", "cut_print", "mix_slot", "p_rank", "s_length", "row", "l_id", "label", "t_hash", "whole", "id", "key", "component_id", "kept", "start", "x")


def clashing(spark, rows):
    """documents with extra columns named like those that operators make."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w


TWINS = (thue_morse(1024), thue_morse(1024).translate(str.maketrans("ab", "ba")))


def test_words_that_collide_as_polynomials():
    (w,) = W.blocks(pa.array([" ".join(TWINS), "a" * 64 + " " + "a" * 65, "A" * 65]))
    assert w.hash[0] != w.hash[1] and len(set(w.hash.tolist())) == 4 and w.hash[3] == w.hash[4]
    tok = WordTokenizer(vocabulary())
    texts = [*TWINS, " ".join(TWINS), "x " + " ".join(reversed(TWINS)), "a" * 40 + " " + "a" * 41]
    for _ in range(2):  # the second time from the memo
        ids, bounds = tok.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tok.library.encode(t, add_special_tokens=False).ids


def test_ids_do_not_depend_on_hashes(monkeypatch):
    rng = random.Random(3)
    plain = W.hashes
    monkeypatch.setattr(W, "hashes", lambda a, s, e, k=0: plain(a, s, e, k) % np.uint64(40) << np.uint64(50))
    tok = WordTokenizer(vocabulary())
    for _ in range(3):
        texts = [" ".join("".join(rng.choice("abé.") for _ in range(rng.randint(1, 50))) for _ in range(20)) for _ in range(40)]
        ids, bounds = tok.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tok.library.encode(t, add_special_tokens=False).ids


def test_packing_against_the_library(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma,", "x"]) for _ in range(rng.randint(0, 150))) for _ in range(60)] + [*TWINS, None, "", "y " * 1500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "nobody")]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary(), capacity=64).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    want = []
    for d, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k in range(-(-len(ids) // 64)):
            n = (len(ids) - 1) % 64 + 1 if k == 0 else 64
            want.append((-1 if d is None else d, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) <= -(-sum(r.length for r in out) // 64) * 1.05 + 1


def follows(packed, order):
    """Whether the sequences of pieces of equal length ascend with the order of the rows."""
    by: dict = {}
    for r in sorted(packed, key=lambda r: (order[r.doc_id], r.piece)):
        by.setdefault(r.length, []).append(r.sequence_id)
    return all(x == sorted(x) for x in by.values())


def test_packing_follows_the_order_of_the_rows(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 40)) for i in range(4000)]
    rng.shuffle(rows)  # the order is not that of ids
    place = {d: k for k, (d, _) in enumerate(rows)}
    written = table_cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(1).sortWithinPartitions(F.lit(1)), "ordered")
    order = {r.doc_id: k for k, r in enumerate(written.select("doc_id", "_metadata.row_index").orderBy("row_index").collect())}
    out = packing.pack_documents(written, vocabulary(), capacity=64, place=packing.file_order(written)).collect()
    assert len(out) == len(rows) and len(place) == len(order)
    assert follows(out, order)
    n = max(r.sequence_id for r in out) + 1
    off = lambda packed: np.mean([abs(order[r.doc_id] / len(rows) - r.sequence_id / n) for r in packed])
    hashed = packing.pack_documents(written, vocabulary(), capacity=64).collect()
    assert not follows(hashed, order) and off(out) < 0.25 * off(hashed)
    assert packing.file_order(spark.range(3).select(F.col("id").alias("doc_id"))) is None


def brute_clusters(texts, min_words, percent):
    """Lines of enough words, linked by exact similarity of five-word shingles, as {(text, line start): cluster}."""
    lines = []
    for d, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            if len(line.split()) >= min_words:
                w = line.split()
                lines.append((d, at, at + len(line), {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
            at += len(line) + 1
    top = list(range(len(lines)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i][3], lines[j][3]
            if 100 * len(a & b) >= percent * len(a | b):
                top[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for i in range(len(lines)):
        first.setdefault(find(i), lines[i][0])
    return {(d, a, b) for i, (d, a, b, _) in enumerate(lines) if first[find(i)] != d}


def test_paragraphs_against_brute_force(spark):
    """Edited copies of lines in groups of 2 to 50, one or two edits each: what goes, and what stays."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts, edited = [], 0
    for size in (2, 3, 8, 8, 20, 50):
        for edits in (0, 1, 2):
            base = [word() for _ in range(100)]
            for k in range(size):
                own = list(base)
                for i in rng.sample(range(100), edits if k else 0):
                    own[i] = word()
                edited += k > 0
                texts.append("\n".join([" ".join(word() for _ in range(30)), " ".join(own), " ".join(word() for _ in range(rng.randint(3, 23)))]))
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = substring_dedup.merged(substring_dedup.find_repeats(df)).collect()
    got = {(r.doc_id, r.start, r.end) for r in spans if r.end - r.start > 300}
    want = brute_clusters(texts, substring_dedup.MIN_WORDS, 80)
    assert len(want) > 0.9 * edited
    found = {(d, a, b) for d, a, b in want if any(x == d and s <= a and e >= b for x, s, e in got)}
    assert len(found) >= 0.95 * len(want)
    assert {d for d, _, _ in got} <= {d for d, _, _ in want} and {r.doc_id for r in spans} <= {d for d, _, _ in want}


def test_tiles_against_all_pairs():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, v, rng.integers(1, 60)).astype(np.int32)) for v in (20, 60, 100_000) for _ in range(40)]
    both = substring_dedup._overlaps(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(120) for j in range(120) if i != j)


def test_awkward_rows_of_paragraphs(spark):
    rng = random.Random(12)
    line = " ".join(f"v{rng.randrange(10**6)}" for _ in range(40))
    long = " ".join(f"u{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(None, line, None, None, None), (4, line, "en", "a", 1), (4, line, "en", "a", 1), (4, "other\n" + line, "en", "a", 1), (7, long, "en", "a", 1), (8, "start " + long, "en", "b", 2), (9, None, None, None, None), (10, "", "en", None, 0)]
    df = clashing(spark, rows)
    out = substring_dedup.remove_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    got = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
    assert (None, line, None) in got  # the least id keeps it
    assert sum(t == "" for d, t, n in got if d == 4) == 2 and (4, "other", 5) in got
    kept = {d: t for d, t, _ in got if d in (7, 8)}
    assert kept[7] == long and len(kept[8]) < 1000
    assert (9, None, None) in got and (10, "", 0) in got
    twice = substring_dedup.merged(substring_dedup.find_repeats(df)).where("doc_id = 4 and start = 0").collect()
    assert len(twice) == 1
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_near_duplicates_with_clashing_names_and_twins(spark):
    rows = [(1, TWINS[0] + " end", "en", "a", 1), (2, TWINS[1] + " end", "en", "a", 1), (3, TWINS[0] + " END", "en", "a", 1), (None, "no id", None, None, None), (5, None, None, None, None), (5, "", None, None, None)]
    rows += [(100 + i, "same text in a large class of copies", "en", "a", 1) for i in range(30)]
    df = clashing(spark, rows)
    out = near_dup.keep_one(df, size=2)
    assert out.columns == df.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in out.collect()) == [-1, 1, 2, 5, 5, 100]


def test_hot_classes_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT_CLASS", 5)
    monkeypatch.setattr(near_dup, "TILE", 4)
    rng = random.Random(2)
    texts = ["one hot text with many copies"] * 40 + ["two copies of this"] * 2
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    for _ in range(30):  # a loose group: near each other, most of them not near enough
        own = list(base)
        for i in rng.sample(range(60), 4):
            own[i] = "edited"
        texts.append(" ".join(own))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))}


def test_mixing_with_clashing_names_and_no_ids(spark):
    rows = [(i, "t", "en", ("a", "b")[i % 2], 1) for i in range(100)] + [(None, f"t{i}", "en", "a", 1) for i in range(20)] + [(7, "t", "en", "b", 1)] * 3
    df = clashing(spark, rows)
    out = mixing.interleave(df, {"a": 2, "b": 1})
    assert out.columns == df.columns and sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))
    mixed = mixing.mix(df, {"a": 2, "b": 1}, block_docs=4)
    assert mixed.columns == [c for c in df.columns if c != "mix_slot"] + list(mixing.MIXED)
    places = [(r.mix_slot, r.mix_class, r.mix_place) for r in mixed.collect()]
    assert len(set(places)) == len(places) == len(rows)
    assert {(r.mix_slot, r.mix_place, r.doc_id) for r in mixed.collect()} == {(r.mix_slot, r.mix_place, r.doc_id) for r in mixing.mix(df, {"a": 2, "b": 1}, block_docs=4, digits=1).collect()}


def test_machine_learns_what_no_linear_model_can(spark):
    """Toxic if exactly one of two terms is there: neither says anything alone."""
    rng = random.Random(10)
    plain = [f"plain{i}" for i in range(60)]
    rows, labels, x = [], [], []
    for i in range(2400):
        has = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(plain) for _ in range(12)] + [w for w, h in zip(("grimble", "thoskar"), has, strict=True) if h]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(has[0] != has[1])))
        x.append((1.0, *map(float, has)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(df, known)
    got = {r.doc_id: r for r in toxicity.score(df, machine, threshold=0.5).collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 600 and sum(got[i].predicted == labels[i][1] for i in held) / len(held) > 0.97
    y = np.array([t for _, t in labels], float)
    linear = np.array(x) @ np.linalg.lstsq(np.array(x), y, rcond=None)[0]
    assert ((linear > 0.5) == (y > 0.5)).mean() < 0.6


def test_fits_take_one_row_for_each_id(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(20)) + (" badword" if i % 2 else "")) for i in range(200)]
    known = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows + rows[:50] * 20, "doc_id long, text string")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    assert toxicity.fit(df, known).bias == pytest.approx(toxicity.fit(once, known).bias)
    a, b = ({r.doc_id: r.score for r in quality.score_documents(d, known).collect()} for d in (df, once))
    assert a == pytest.approx(b)


LONG = "A long sentence of the article, with some commas, and words enough to count as prose in any case. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><form id=f><input type=hidden name=v><nav>menu</nav><div><h1>T</h1><p>{LONG}</p><p>{LONG}x</p></div><input name=q></form></body>", f"T\n{LONG.strip()}\n{LONG}x"),
        (f"<body><article><h1>T</h1><p>{LONG}</p></article><form><p>Write to us, please, with name, street, and town.</p><input><input><button>Go</button></form></body>", f"T\n{LONG.strip()}"),
        (f"<body><div class=w1><div><p>{LONG}a</p><p>{LONG}b</p></div></div><div class=w2><div><p>{LONG}c</p></div></div><div class=footer><p>Imprint</p></div></body>", f"{LONG}a\n{LONG}b\n{LONG}c"),
        (f"<article><h1>H</h1><div class=content><p>{LONG}1</p><p>{LONG}2</p></div><p>Short end.</p><ul><li>item one</li></ul><blockquote>Quoted.</blockquote></article>", f"H\n{LONG}1\n{LONG}2\nShort end.\nitem one\nQuoted."),
        (f"<main><article><p>{LONG}</p></article><div class=related><p>{LONG}</p></div><div class=comments><p>{LONG}</p></div></main>", LONG.strip()),
        (f"<body><div><p>{LONG}</p><p>{LONG}y</p></div><div><a href=a>one link</a><a href=b>and another</a></div><p>&copy; 2024</p></body>", f"{LONG.strip()}\n{LONG}y"),
        ("", ""), (None, ""), ("<nav><p>only a menu</p></nav>", ""), ("<p>&lt;b&gt; &amp;\n x</p>", "<b> & x"),
    ],
)
def test_pages_of_many_shapes(page, text):
    assert html_extract.extract(page) == text


def test_token_files_of_repeated_rows(spark):
    df = spark.createDataFrame([(2, "b b"), (1, "a"), (2, "b b"), (2, "a a"), (None, None)], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_token_files(token_files.write_token_files(df, vocabulary())).collect())
    assert [d for _, d, _ in got] == [None, 1, 2, 2, 2] and got[0][0] == 0 and all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_addresses_of_stores():
    assert token_files.known_uri("s3a://bucket/a") == "s3://bucket/a" and token_files.known_uri("file:///tmp/x") == "file:///tmp/x"
    assert token_files.known_uri("abfss://c@a.dfs.core.windows.net/x").startswith("abfss://")


# The pipeline


def pipeline_rows():
    rng = random.Random(20)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    say = lambda n: " ".join(" ".join(word() for _ in range(rng.randint(5, 12))).capitalize() + "." for _ in range(n))
    passage = " ".join(word() for _ in range(70))
    rows, labels = [], []
    for i in range(160):
        bad = i % 8 == 0
        text = " ".join(["###", "!!!"] * 40) if bad else say(8)
        if i in (21, 22, 23):
            text = f"{say(4)}\n{passage}\n{say(4)}"
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        labels.append((i, int(not bad), 0))
    rows += [(500, rows[1][1], "en", "src1", 9), (501, rows[1][1] + " tail", "en", "src1", 9), (600, None, None, None, None), (601, "", "en", "src2", 0), (None, say(8), "en", "src3", 9), (602, "long " + " ".join(word() for _ in range(30_000)), "en", "src0", 5)]
    rows += [rows[2], rows[2]]
    return rows, labels, passage


def test_pipeline_stage_by_stage(spark, tmp_path):
    rows, labels, passage = pipeline_rows()
    df = clashing(spark, rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    texts = lambda d: sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in d.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    step = lambda name, d: table_cut(stages[name](spark, d, str(tmp_path)), name)
    good = step("quality_classifier", df)
    assert good.columns == df.columns
    ids = {r.doc_id for r in good.collect()}
    assert ids >= {i for i in range(160) if i % 8} and not ids & {i for i in range(160) if i % 8 == 0}
    unique = step("minhash_near_dedup", good)
    assert unique.columns == df.columns
    # Brute force: of each component of exact similarity the least id stays.
    seen: list[tuple[int, set]] = []
    want = []
    for d, t in texts(good):
        w = t.lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        if d == -1 or not s or not any(x != d and s and 100 * len(s & o) >= 80 * len(s | o) for x, o in seen):
            want.append((d, t))
            seen.append((d, s))
    assert texts(unique) == want
    cut = step("substring_dedup", unique)
    assert cut.columns == df.columns and cut.count() == unique.count()
    left = dict(texts(cut))
    assert passage in left[21] and passage not in left[22] and passage not in left[23]
    assert all(left[d] == t for d, t in texts(unique) if d not in (2, 22, 23))
    mixed = step("source_mixing", cut)
    assert mixed.columns == df.columns and texts(mixed) == texts(cut)
    packed = stages["best_fit_packing"](spark, mixed, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}
    # The mixed order has its say.
    order = {r.doc_id: (r.f, r.n) for r in mixed.select("doc_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("n")).collect()}
    assert follows([r for r in packed if r.doc_id != 2], order)  # rows of document 2 repeat


def test_pipeline_over_an_empty_table(spark, tmp_path):
    rows, labels, _ = pipeline_rows()
    clashing(spark, rows).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels[:0], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
