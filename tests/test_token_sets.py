"""Alignment of whole blocks before pairs are scored (F10) against the score itself."""

from __future__ import annotations

import random

import numpy as np
import pytest

from millrace.functions import token_sets
from millrace.functions.profiles import Profiles, profile
from millrace.functions.udfs import common_tokens_ratio, token_set_ratio


def _text(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeinrstéß漢") for _ in range(rng.randint(1, 9))) for _ in range(n))


def _changed(rng: random.Random, text: str, edits: int) -> str:
    for _ in range(edits):
        i = rng.randint(0, len(text))
        text = rng.choice((text[:i] + text[i + 1 :], text[:i] + rng.choice("aes ") + text[i:]))
    return text


@pytest.mark.parametrize("threshold", [60.0, 90.0, 97.5])
def test_no_pair_that_reaches_the_threshold_is_left_out(threshold, monkeypatch):
    monkeypatch.setattr(token_sets, "PAIRS", 300)
    rng = random.Random(7)
    keys = [_text(rng, n) for n in (1, 2, 3, 9, 20, 21, 40, 60)] + ["", "a", _text(rng, 700)]
    texts = [_changed(rng, k, e) for k in keys for e in (0, 1, 3, len(k) // 20, len(k) // 10, len(k) // 6)]
    texts += [" ".join(reversed(k.split())) for k in keys] + [_text(rng, 20) for _ in range(20)]
    texts = [t for t in texts if t.split()]
    sets, every = token_sets.TokenSets(texts, threshold), np.arange(len(texts))
    found = [p for k, key in enumerate(keys) for p in sets.add(k, key, every)] + list(sets.rest())
    assert len(found) == len(set(found))
    want = {(i, k) for i, t in enumerate(texts) for k, key in enumerate(keys) if token_set_ratio(t, key, threshold) >= threshold}
    assert want and want <= set(found)


def test_pairs_of_like_counts_are_not_scored_one_by_one():
    """Texts of the same characters and of many equal neighbours in other words: by counts nearly all were scored."""
    rng = random.Random(3)
    parts = ["the", "er", "en", "tion", "an", "in", "re"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(60)) for _ in range(60)]
    profiled, counted, found = Profiles.of(texts[:30]), 0, []
    sets = token_sets.TokenSets(profiled.texts, 90.0)
    for k, key in enumerate(texts[30:]):
        near = np.array(profiled.near(key, profile(key)[1].astype("<i2").tobytes(), 0.9), np.int64)
        counted += len(near)
        found += sets.add(k, key, near)
    found += sets.rest()
    assert counted > 100
    assert not found


def test_common_tokens_alone_give_their_part_of_the_score():
    assert common_tokens_ratio("red hot iron", "iron hot") == token_set_ratio("red hot iron", "iron hot") == 100.0
    assert common_tokens_ratio("abcdefgh xyz", "abcdefgh xyw") == 200.0 * 8 / 20
    assert token_set_ratio("abcdefgh xyz", "abcdefgh xyw") == pytest.approx(200.0 * 11 / 24)
    assert common_tokens_ratio("abcd", "abce") == common_tokens_ratio("", "abc") == 0.0
