"""Parts of the training-data operators that need no Spark."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import ans, html_extract, lattice, near_dup, packing, quality, substring_dedup, toxicity
from millrace.llm import words as W
from millrace.llm.queries import vocabulary
from millrace.llm.tokens import WordTokenizer


def test_words_are_cut_at_ascii_space():
    texts = ["A b\tc\n", None, "", "  é x\u00a0y ", "one"]
    (w,) = W.blocks(pa.array(texts))
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[s:e], w.end[s:e], strict=True)] for s, e in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    assert got == [["A", "b", "c"], [], [], ["é", "x\u00a0y"], ["one"]]
    same = next(W.blocks(pa.array(["The THE the thE", "É é"])))
    assert len(set(same.hash[:4].tolist())) == 1 and len(set(same.hash[4:].tolist())) == 2


def test_shingles_match_brute_force():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    (w,) = W.blocks(pa.array(texts))
    values, bounds = W.distinct(*W.shingles(w, 2))
    names: dict[int, tuple] = {}
    for i, t in enumerate(texts):
        x = t.split()
        want = set(zip(x, x[1:], strict=False)) if len(x) > 1 else {tuple(x)} if x else set()
        assert bounds[i + 1] - bounds[i] == len(want)
    a, b = next(W.blocks(pa.array(["a b c", "b c"]))), None
    va, ba = W.shingles(a, 2)
    assert va[1] == va[2] and names == {} and b is None and list(ba) == [0, 2, 3]


def test_tokenizer_gives_the_librarys_ids():
    rng = random.Random(6)
    tok = WordTokenizer(vocabulary())
    alphabet = [" ", "  ", "\n", "\n\n", "\t", "a", "Bc", "é", "!", "'s", "12", " ", "\r\n", "x", ".", "<|endoftext|>", "<", "“", "×.", "ß.", "…", "word", "日本", "\u3000", "\x85", "***"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 10))) for _ in range(3000)]
    ids, bounds = tok.encode(pa.array([*texts, None]))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tok.library.encode(t, add_special_tokens=False).ids, t
    assert bounds[-1] == bounds[-2]


@pytest.mark.parametrize("n", [0, 1, 15, 17, 5000, 300_000])
def test_ans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.4, n), 60_000).astype(np.uint32)
    counts = [n // 3, 0, n - n // 3]
    f = ans.TokenFile(ans.pack([5, None, 7], np.array(counts), ids))
    got = list(f.documents())
    assert [d for d, _ in got] == [5, None, 7] and np.array_equal(np.concatenate([x for _, x in got]), ids)


def test_ans_notices_damage():
    data = bytearray(ans.pack([1], np.array([4000]), np.arange(4000, dtype=np.uint32) % 50))
    data[-5] ^= 1
    with pytest.raises(ValueError):
        list(ans.TokenFile(bytes(data)).documents())
    data[60] ^= 1
    with pytest.raises(ValueError):
        ans.TokenFile(bytes(data))


def _least(items: list[int], room: int) -> int:
    """Fewest bins by trying everything."""
    best = len(items)

    def put(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= items[i]:
                bins[k] -= items[i]
                put(i + 1, bins)
                bins[k] += items[i]
        put(i + 1, [*bins, room - items[i]])

    put(0, [])
    return best


def test_packing_plans():
    rng = random.Random(8)
    worse = 0
    for _ in range(150):
        room = rng.choice([10, 12, 20])
        items = sorted((rng.randint(1, room) for _ in range(rng.randint(0, 8))), reverse=True)
        counts = {k: items.count(k) for k in set(items)}
        fixed, rest = packing.reduce_dominated(counts, room)
        p = fixed + packing.best_fit(rest, room)
        assert all(t > 0 and sum(a * m for a, m in s) <= room for t, s in p)
        assert sorted(a for t, s in p for a, m in s for _ in range(t * m)) == sorted(items)
        best = _least(items, room)
        # The reduction is never at fault: what it fixed and the best of the rest are the best of all.
        left = sorted((k for k, v in rest.items() for _ in range(v)), reverse=True)
        assert sum(t for t, _ in fixed) + _least(left, room) == best
        worse += sum(t for t, _ in p) > best
    assert worse <= 5


def test_e8_points_are_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 2
    p = lattice.decode(x)
    d = ((x - p) ** 2).sum(1)
    assert d.max() <= 1 + 1e-9 and len(lattice.ROOTS) == 240
    for r in lattice.ROOTS:  # no neighbour is nearer
        assert (((x - p - r) ** 2).sum(1) >= d - 1e-9).all()


def test_lattice_recall():
    rng = np.random.default_rng(4)
    u = rng.normal(size=(3000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = rng.normal(size=u.shape)
    v -= (v * u).sum(1, keepdims=True) * u
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = 0.98 * u + np.sqrt(1 - 0.98**2) * v
    z = np.zeros(len(u), np.int64)
    a, b = lattice.cells(u, z), lattice.cells(w, z)
    found = np.array([bool(set(x) & set(y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    assert found.mean() >= 0.995


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for n in (3, 40, 2000):
        base = rng.integers(0, 2**63, n + n // 4 + 1, dtype=np.uint64)
        a, b = base[:n], base[n // 8 :]
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = (near_dup.signature(a, 4096) == near_dup.signature(b, 4096)).mean()
        assert abs(same - j) < 0.1 + 0.5 / n
    assert len(set(near_dup.signature(np.array([9], np.uint64)).tolist())) == 1


HTML = """<!doctype html><html><head><title>T</title><script>var a = "</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home, and more, and more</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many cookies, really very many of them, and more than that.</p></div>
<div id=main><article><h1>Head &amp; title</h1><p>First paragraph, with <b>bold</b> and <a href=x>a link</a>,
 on two lines.<p>Second one&nbsp;here, unclosed, with commas, and words enough to count as text.
<div class="share"><a href=#>Share</a></div><form><p>Name, please, your name</p></form>
<ul><li>item one</li><li>item two</li></ul>tail text</article></div>
<aside><p>Related, other, stories, that are long, long, long enough to look like text.</p></aside>
<section id="comments"><p>A reader, I, say, many, things, with commas, and at length, really at length.</p></section>
<footer><p>Imprint, privacy, and so on, and on, and on, and on, and on.</p></footer></body></html>"""


def test_extraction():
    want = "Head & title\nFirst paragraph, with bold and a link, on two lines.\nSecond one here, unclosed, with commas, and words enough to count as text.\nitem one\nitem two\ntail text"
    assert html_extract.extract(HTML) == want
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p></p>") == ""
    assert html_extract.extract("<article><p>Hi</p></article>") == "Hi"
    assert html_extract.extract("<script>never closed <p>x</p>") == ""
    deep = "<div>" * 5000 + "text" + "</div>" * 5000
    assert html_extract.extract(deep) == "text"
    assert html_extract.extract("<article><h1>A</h1><div class=ad>Buy, now</div><p>b &lt;i&gt; c</p></article>") == "A\nb <i> c"


def test_quality_features_and_fit():
    rng = random.Random(1)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)) + "." for _ in range(150)]
    bad = [("Spam " * rng.randint(20, 90)) if k % 2 else " ".join(f"{x}***" for x in good[k].split()).upper() for k in range(60)]
    x = quality.features(pa.array([*good, *bad]))
    y = np.array([1.0] * len(good) + [0.0] * len(bad))
    order = np.random.default_rng(1).permutation(len(y))
    fit, held = order[::2], order[1::2]
    m = quality.learn(x[fit], y[fit])
    assert ((m.score(x[held]) >= 0.3) == (y[held] == 1)).mean() > 0.97
    assert np.isfinite(quality.features(pa.array(["", None, " ", "\n\n", "a"], pa.string()))).all()
    assert quality.learn(x[:5], y[:5]).score(x[:2])[0] > 0.99 and quality.learn(x[:0], y[:0]).score(x[:1])[0] > 0.99


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(2)
    x = (rng.random((1200, 12)) < 0.4).astype(np.float32)
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)  # neither term alone says it
    bias, w, v = toxicity._learn(x, y, np.ones(len(y)))
    z = bias + x @ w + 0.5 * ((x @ v) ** 2 - x @ v**2).sum(1)
    assert ((z > 0) == (y > 0)).mean() > 0.97


def test_paragraphs_are_cut_alike_anywhere():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(4, 12))) + "."
    caught = 0
    for _ in range(60):
        passage = " ".join(sentence() for _ in range(9))
        texts = [f"{sentence()} {word()} {word()} {passage} {word()} {sentence()}\n{sentence()}", f"{sentence()}\n{word()} {passage} {sentence()}"]
        (w,) = W.blocks(pa.array(texts))
        a, full = (np.concatenate(x) for x in zip(*((found[0], found[2]) for found in (substring_dedup.paragraphs(w), substring_dedup.anchored(w))), strict=True))
        doc = np.searchsorted(w.bounds, a, "right") - 1
        caught += bool(set(full[doc == 0].tolist()) & set(full[doc == 1].tolist()))
    assert caught == 60
    for text in ("", "one two", "a. b. c."):
        assert len(substring_dedup.paragraphs(next(W.blocks(pa.array([text]))))[0]) == 0
