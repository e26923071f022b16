"""The training-data operators on small tables, against brute force and with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, fingerprint, html_extract, lattice, mixing, near_dup, packing, quality, substring_dedup, token_files, toxicity
from millrace.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


def sentence(rng: random.Random, n: int | None = None) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n or rng.randint(4, 12))).capitalize() + "."


def corpus(seed: int = 1) -> list[tuple]:
    """Texts with copies, near copies, nulls, empty and repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(seed)
    texts: list[str | None] = [" ".join(sentence(rng) for _ in range(rng.randint(1, 12))) for _ in range(30)]
    for k in range(8):
        w = texts[k].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "one", "ONE", "", None, " \n", "two words", "x " * 3000]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or ""), None, "k") for i, t in enumerate(texts)]
    return [*rows, (None, "no id here", None, None, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)]
    top = {x: x for e in links for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_all_pairs(spark, docs):
    rows = corpus()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()
    ids = [d for d in sets if d is not None]
    top = {d: d for d in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {d: (len(s), None if d is None else find(d), True if d is None else find(d) == d) for d, s in sets.items()}
    kept = near_dup.keep_one(docs, 2)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, v in got.items() if v[2]}
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_loose_groups_are_settled(spark):
    """A group in which most pairs are near the limit: stars alone don't hold it together."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w), None, None, None, None, None))
    s = [set(zip(r[1].split(), r[1].split()[1:], strict=False)) for r in rows]
    label = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == dict(enumerate(label))


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 16))
    noisy = base[:20] + rng.normal(size=(20, 16)) * 0.06
    vectors = np.concatenate([base, noisy, base[:5], 3 * base[:2]]).astype(np.float32)
    label = [i % 2 for i in range(60)] + [i % 2 for i in range(20)] + [0, 1, 0, 1, 1] + [0, 1]
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(vectors, label, strict=True))]
    odd = [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [1.0, None], 1), (104, base[0].tolist(), None), (105, [], 0), (106, [1.0, 2.0], 0), (107, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("k", F.lit(1)).withColumn("n", F.lit("x"))
    good = [r for r in rows] + [(i, v, y) for i, v, y in odd if i >= 106]
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v, _ in good}
    links = {i: 0 for i, *_ in rows + odd}
    top = {i: i for i in links}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, u, a in good:
        for j, v, b in good:
            if i != j and a == b and len(u) == len(v) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    for tile in (2048, 3):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(df, tile=tile).collect()}
        assert got == {i: (n, find(i), find(i) == i) for i, n in links.items()}
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_fingerprints_against_sets(spark, docs):
    got = fingerprint.edit_likeness(docs.repartition(3)).collect()
    rows = sorted(((-(2**63) if d is None else d, d, t or "") for d, t, *_ in corpus()), key=lambda r: (r[0], r[2]))
    split = lambda x: {y for y in re.split(r"\n+|(?<=[.!?])[ \t\n\x0b\f\r]+", x) if y}

    def near(a, b):
        a, b = split(a), split(b)
        return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0

    want = {}
    for i, (_, d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][2]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        want[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), near(t, edited), near(t, after))
    assert {r.doc_id: (r.n_chars, r.edited_sha256, pytest.approx(r.near_edited), pytest.approx(r.near_next)) for r in got} == want
    by_text: dict[str, set] = {}
    texts = {d: t for _, d, t in rows}
    for r in got:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({x for v in by_text.values() for x in v}) == len(by_text)
    assert fingerprint.edit_likeness(docs.limit(0)).count() == 0
    one = fingerprint.edit_likeness(docs.limit(1)).first()
    assert one.near_next == 1.0


def test_peeling_recovers_the_difference(spark):
    rng = random.Random(4)
    both = [sentence(rng) for _ in range(40)]
    a, b = [*both, "Only in a."], [*both[1:], "Only in b.", "Also in b."]
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string").select(F.expr(fingerprint.codes("a")).alias("a"), F.expr(fingerprint.codes("b")).alias("b"))
    r = df.select("a", "b", F.expr(fingerprint.peel(fingerprint.subtract(fingerprint.sketch("a"), fingerprint.sketch("b")))).alias("d")).first()
    assert set(r.d) == set(r.a) ^ set(r.b) and len(r.d) == 4


def test_passages_are_removed_from_later_texts(spark):
    rng = random.Random(6)
    passage = " ".join(sentence(rng) for _ in range(9))
    own = [" ".join(sentence(rng) for _ in range(10)) for _ in range(6)]
    texts = [f"{own[0]} and {passage} {own[1]}", own[2], f"{own[3]}\n{passage}\n{own[4]}", own[5], None, "", own[5][:40]]
    rows = [(i, t, "en", "s", len(t) if t is not None else None, None, "k") for i, t in enumerate(texts)]
    df = frame(spark, rows)
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    assert substring_dedup.remove_repeats(df).columns == df.columns
    tail = " ".join(passage.split()[15:40])
    assert tail in out[0].text and tail not in out[2].text and own[3] in out[2].text and own[4] in out[2].text
    assert out[2].n_chars == len(out[2].text)
    assert all(out[i].text == texts[i] for i in (1, 3, 4, 5, 6))
    found = substring_dedup.merged(substring_dedup.find_repeats(df)).collect()
    assert {r.doc_id for r in found} == {2} and {r.first_doc_id for r in found} == {0}
    assert substring_dedup.find_repeats(df.limit(0)).count() == 0


def test_mixing_keeps_shares_and_rows(spark):
    rows = [(i, "t", None, "a" if i < 200 else "b" if i < 260 else "c" if i < 290 else None, 1, None, None) for i in range(300)]
    df = frame(spark, rows)
    units = {"a": 5, "b": 3, "c": 1}
    out = mixing.mix(df, units, rest=1, block_docs=4).collect()
    assert sorted(r.doc_id for r in out) == list(range(300))
    # As long as no source has run out, each has had its share to within less than a block.
    places = sorted((r.mix_slot, r.mix_class) for r in out if r.mix_place == 0)
    had = [0, 0, 0, 0]
    for slot, c in places:
        if slot >= 30:
            break
        had[c] += 1
        assert all(abs(n - u * (slot + 1) / 10) < 1 for n, u in zip(had, (5, 3, 1, 1), strict=True)), slot
    assert mixing.interleave(df, units).columns == df.columns
    assert mixing.mix(df.limit(0), units).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(spark, [1, 0])


def test_packing_is_whole_and_gapless(spark, docs):
    out = packing.pack_documents(docs, vocabulary(), capacity=64).collect()
    by_doc: dict = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {r[0] for r in corpus()}
    for parts in by_doc.values():
        parts.sort(key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and all(p.length == 64 for p in parts[1:])
        assert [p.start for p in parts] == list(np.cumsum([0, *[p.length for p in parts]])[:-1])
    by_sequence: dict = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) <= -(-sum(r.length for r in out) // 64) * 1.1 + 1
    assert packing.pack_documents(docs.limit(0), vocabulary()).count() == 0


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    manifest = token_files.write_token_files(docs, vocabulary(), file_tokens=400)
    assert manifest.count() > 3
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest).collect()}
    want, start = {}, 0
    for d, t, *_ in sorted(corpus(), key=lambda r: (-1 if r[0] is None else r[0])):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), vocabulary())).count() == 0


def test_classifiers(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(400):
        t = " ".join(sentence(rng) for _ in range(5))
        bad, toxic = i % 5 == 0, i % 4 == 1
        if bad:
            t = ("Junk " * 60) if i % 2 else " ".join(f"{w}###" for w in t.split())
        if toxic:
            t += " grumblefool " + sentence(rng)
        rows.append((i, t, "en", "s", len(t), None, "k"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None, None, None, None, None, None), (1001, "", None, None, None, None, None), (None, "x", None, None, None, None, None)]
    labels += [(2000, 1, 0), (1000, None, None), (None, 1, 1)]
    df, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for out, k in ((quality.score_documents(df, known), 1), (toxicity.score(df, toxicity.fit(df, known)), 2)):
        got = out.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
        assert all(zlib.crc32(str(r.doc_id).encode()) % (5 if k == 1 else 3) == (0 if k == 1 else 1) for r in held) and len(held) > 50
        assert sum(r.predicted == labels[r.doc_id][k] for r in held) / len(held) > 0.95
    kept = quality.keep_good(df, known)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(400) if i % 5}
    none = known.limit(0)
    assert {r.predicted for r in quality.score_documents(df, none).collect()} == {1}
    assert {r.predicted for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0}
    assert quality.score_documents(df.limit(0), known).count() == 0


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Hi</p></article>", 5), (2, None, None, 6), (2, "v", "", 7)], "page_id long, url string, html string, text int")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract_main_text(df).collect()]
    assert sorted(got) == [(1, "Hi", 2), (2, "", 0), (2, "", 0)]
