from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import scores, text, udfs
from millrace.functions.udfs import greedy_match_block, greedy_match_f1, indel_ratio, rouge_l, stem, token_set_ratio
from millrace.operators.chunking import chunk_text
from millrace.operators.providers import Backend, RateLimited, SlidingLimit, chain_of, run_chain


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize_and_tokenize(spark):
    assert one(spark, text.normalize(F.lit("  What's_an  E-UTRAN?\n"))) == "what s an e utran"
    assert one(spark, text.tokenize(F.lit("A_b, c4! Été"))) == ["a_b", "c4", "été"]
    assert one(spark, text.tokenize(F.lit(""))) == []
    assert one(spark, text.word_count(F.lit("  a  b\tc\n"))) == 3


def test_sigmoid_has_no_overflow(spark):
    assert one(spark, scores.sigmoid(F.lit(0.0))) == 0.5
    assert one(spark, scores.sigmoid(F.lit(800.0))) == pytest.approx(1.0)
    assert one(spark, scores.sigmoid(F.lit(-800.0))) == pytest.approx(0.0)


def test_recall_and_reciprocal_rank(spark):
    got, want = F.array(*map(F.lit, ["a", "b", "b", "c"])), F.array(*map(F.lit, ["c", "b", "b"]))
    assert one(spark, scores.recall_at(got, want, 2)) == 0.5
    assert one(spark, scores.recall_at(got, want, 0)) == 0.0
    assert one(spark, scores.recall_at(got, F.array().cast("array<string>"), 3)) == 0.0
    assert one(spark, scores.reciprocal_rank(got, want)) == 0.5
    assert one(spark, scores.reciprocal_rank(got, F.array(F.lit("z")))) == 0.0


def test_json_array_tells_empty_from_unreadable(spark):
    s = "array<struct<k: int>>"
    assert one(spark, text.json_array(F.lit('```json\n[{"k": 1}]\n```'), s))[0]["k"] == 1
    assert one(spark, text.json_array(F.lit("[]"), s)) == []
    assert one(spark, text.json_array(F.lit("nothing"), s)) is None


def test_spec_and_series(spark):
    assert one(spark, text.spec_of(F.lit("3GPP TS 36.300"))) == "36.300"
    assert one(spark, text.spec_of(F.lit("other"))) == "other"
    assert one(spark, text.spec_of(F.lit(None).cast("string"))) == "(unknown)"
    assert one(spark, text.series_name(F.lit("36.300"))) == "36_series"


def test_token_set_ratio():
    assert token_set_ratio("a b c", "c b a") == 100.0
    assert token_set_ratio("a b", "a b c d") == 100.0
    assert token_set_ratio("x", "qqqq") < 50
    assert token_set_ratio("", "a") == 0.0
    assert indel_ratio("abcd", "abxd") == pytest.approx(75.0)


def test_rouge_and_stems():
    assert rouge_l("the cat sat", "the cat sat") == 1.0
    assert rouge_l("", "x") == 0.0
    assert rouge_l("c b a", "a b c") < 1.0
    assert rouge_l("running connections", "run connect") == pytest.approx(1.0)  # "run" is too short to be stemmed and meets "running"'s stem
    for word, root in {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "happy": "happi", "adjustment": "adjust", "controlling": "control"}.items():
        assert stem(word) == root


def test_greedy_match_bounds():
    import numpy as np

    a = np.eye(3)
    assert greedy_match_f1(a, a) == pytest.approx(1.0)
    assert greedy_match_f1(a, np.zeros((0, 3))) == 0.0


def test_chunks_follow_their_specification():
    assert chunk_text(None) == [] and chunk_text("  ab ") == ["ab"]
    words = " ".join(f"w{i:03d}" for i in range(200))
    parts = chunk_text(words, 50, 10)
    assert all(len(p) <= 60 for p in parts)
    assert {w for p in parts for w in p.split()} == set(words.split())
    # A piece joins the cut window whatever its size: a chunk may exceed the size by about the overlap.
    over = chunk_text("a" * 9 + "\n\n" + "b" * 48 + "\n\n" + "c" * 10, 50, 10)
    assert over[0] == "a" * 9 and max(map(len, over)) > 50
    hard = chunk_text("x" * 120, 50, 10)
    assert "".join(hard).count("x") >= 120


def test_provider_chain():
    calls: list[str] = []

    def fails(p: str) -> str:
        calls.append(p)
        raise RuntimeError("no")

    def limited(p: str) -> str:
        raise RateLimited("later")

    waits: list[float] = []
    r = run_chain([Backend("a", fails), Backend("l", limited), Backend("b", lambda p: "yes it is")], "q", sleep=waits.append)
    assert r["backend"] == "b" and r["tokens_used"] == 3 and len(r["failures"]) == 2
    assert len(calls) == 3 and waits == [1.0, 2.0]
    assert run_chain([Backend("a", fails)], "q", sleep=waits.append)["answer"] is None
    assert [b.name for b in chain_of(["b", "a", "b", "z"], {"a": fails, "b": fails})] == ["b", "a"]
    with pytest.raises(ValueError):
        chain_of(["z"], {"a": fails})


def test_sliding_limit():
    now, slept = [0.0], []
    limit = SlidingLimit(2, 60.0, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        limit.wait()
    assert slept == [60.0]


def test_token_vectors_of_a_provider(spark):
    rng = np.random.default_rng(3)
    left = [rng.normal(size=(n, 5)) for n in (0, 1, 3, 40, 2, 7, 7)]
    right = [rng.normal(size=(n, 5)) for n in (4, 1, 0, 3, 90, 7, 6)]
    left += [np.zeros((2, 5)), -left[1]]
    right += [rng.normal(size=(3, 5)), left[1]]
    want = [greedy_match_f1(a, b) for a, b in zip(left, right, strict=True)]
    assert greedy_match_block(left, right).tolist() == pytest.approx(want, abs=1e-12)
    monkey = udfs._MATCH_BLOCK
    udfs._MATCH_BLOCK = 2
    try:
        assert greedy_match_block(left, right).tolist() == pytest.approx(want, abs=1e-12)
    finally:
        udfs._MATCH_BLOCK = monkey

    def letters(texts):
        if len(set(texts)) != len(texts):
            raise ValueError("a text came twice")
        return [np.array([[t.count("a"), t.count("b"), 1.0] for t in x.split()]).reshape(-1, 3) for x in texts]

    rows = spark.createDataFrame([("aa b", "aa b"), ("aa b", "ba"), (None, "a"), ("", "")], "p string, r string").coalesce(1)
    got = [r.s for r in rows.select(udfs.token_match(letters)("p", "r").alias("s")).collect()]
    assert got == pytest.approx([greedy_match_f1(*letters([p])[:1], *letters([r])[:1]) for p, r in (("aa b", "aa b"), ("aa b", "ba"), ("", "a"), ("", ""))])
    stand_in = [greedy_match_f1(*udfs.trigram_vectors([a, b])) for a, b in (("the cat sat", "the cats sat down"),)]
    assert spark.createDataFrame([("the cat sat", "the cats sat down")], "p string, r string").select(udfs.token_match_f1_udf("p", "r")).first()[0] == pytest.approx(stand_in[0])


def test_maps_with_defaults(spark):
    rows = spark.createDataFrame([(1, {"a": "x", "b": "y"}, {"b": "z", "c": "w"}), (2, None, {"c": "w"}), (3, {"a": "x"}, None), (4, None, None)], "i int, m map<string,string>, n map<string,string>")
    got = {r.i: (r.a, r.m) for r in rows.select("i", text.entry(F.col("m"), "a", "none").alias("a"), text.merged(F.col("m"), F.col("n")).alias("m")).collect()}
    assert got == {1: ("x", {"a": "x", "b": "z", "c": "w"}), 2: ("none", {"c": "w"}), 3: ("x", {"a": "x"}), 4: ("none", None)}
