"""Findings of the third round."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from millrace.functions import edits, udfs
from millrace.operators import dedup, promote, retrieval, topk


def _distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_near_pairs_against_the_table(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(edits, "PAIRS", 100)
    left = ["".join(rng.choice("abcdef é漢") for _ in range(n)) for n in (1, 2, 7, 40, 63, 64, 65, 128, 129) for _ in range(3)]
    right = []
    for x in left:
        y = list(x)
        for _ in range(rng.randint(0, len(x) // 4)):
            y[rng.randrange(len(y))] = rng.choice(["a", "", "bc"])
        right.append("".join(y) or "z")
    longer = np.maximum.outer([len(x) for x in left], [len(y) for y in right])
    want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if _distance(x, y) <= int(0.3 * longer[i, j] + 1e-9)}
    assert len(want) >= 15
    for steps in (3, 48):
        monkeypatch.setattr(edits, "STEPS", steps)
        assert set(zip(*(v.tolist() for v in edits.near_pairs(left, right, longer, 0.3)), strict=True)) == want


def test_near_pairs_whose_last_row_fills_a_step(monkeypatch):
    """Nothing is left to measure after the last text."""
    monkeypatch.setattr(edits, "PAIRS", 12)
    left, right = ["abcdefghij"] * 4, ["abcdefghij", "abcdefghix", "abcdefxxxx"]
    p, q = edits.near_pairs(left, right, np.full((4, 3), 10), 0.3)
    assert set(zip(p.tolist(), q.tolist(), strict=True)) == {(i, j) for i in range(4) for j in range(2)}


def test_promotion_compares_equal_questions_once(spark, monkeypatch):
    """A large group of copies gives no pair, and blocks of any size the same gates."""
    fifty = "word " * 50
    rng = random.Random(6)
    texts = ["copy of a question"] * 300 + ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30))) for _ in range(100)]
    rows = [(i, t, fifty, 0.9) for i, t in enumerate(texts)]
    c = spark.createDataFrame(rows, "ordinal long, question string, answer string, confidence double").selectExpr("*", "cast(null as boolean) as answer_in_chunk")
    seen, kept = [], set()
    for i, t in enumerate(texts):
        if not any(_distance(t, u) <= 0.3 * max(len(t), len(u)) + 1e-9 for u in seen):
            seen.append(t)
            kept.add(i)
    monkeypatch.setattr(promote, "BLOCK_LEAST", 4)
    monkeypatch.setattr(promote, "BLOCK_MOST", 7)
    pairs = []
    monkeypatch.setattr(promote, "greedy", lambda p, f=promote.greedy: pairs.append(p.count()) or f(p))
    got = promote.promote(c, spark.createDataFrame([], "question string")).collect()
    assert {r.ordinal for r in got if r.gate is None} == kept and len(got) == 400
    assert pairs[0] < 101 * 100 / 2


def test_many_queries_are_scored_text_by_text(spark, monkeypatch):
    """The same hits as from the lists, without a row for each query and text with a common token; ties by id."""
    rng = random.Random(7)
    said = lambda n: " ".join(rng.choice("abcdefghijklm") * rng.choice([1, 1, 2, 3]) for _ in range(n))
    docs = spark.createDataFrame([(i, said(rng.randint(0, 30))) for i in range(300)], "doc_id long, text string")
    queries = spark.createDataFrame([(f"q{i}", said(rng.randint(0, 9))) for i in range(60)], "query_id string, query string")
    index = retrieval.bm25_index(docs)
    rows = lambda idf: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 8)) for r in retrieval.bm25_search(index, queries, 7, idf).collect())
    for idf in ("documented", "okapi_floor"):
        want = rows(idf)
        for name, value in (("SCAN_FROM", 1), ("SCAN_BLOCK", 100), ("COMMON", 5)):
            monkeypatch.setattr(retrieval, name, value)
        monkeypatch.setattr(topk, "CELLS", 200)
        monkeypatch.setattr(retrieval, "_bounds", None)  # the lists' way is not taken
        assert rows(idf) == want and len(want) > 200
        monkeypatch.undo()


def test_a_search_through_texts_writes_no_lists(spark, monkeypatch, tmp_path):
    """Lists are written by the first search that reads them, and hold the same hits."""
    docs = spark.createDataFrame([(i, f"common word{i % 9} other{i % 4}") for i in range(90)], "doc_id long, text string")
    queries = spark.createDataFrame([(f"q{i}", f"word{i} common") for i in range(9)], "query_id string, query string")
    index = retrieval.bm25_index(docs, path=str(tmp_path / "i"), lists=False)
    rows = lambda: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 8)) for r in retrieval.bm25_search(index, queries, 5).collect())
    monkeypatch.setattr(retrieval, "SCAN_FROM", 1)
    through = rows()
    assert not (tmp_path / "i" / "blocks").exists() and len(through) == 45
    monkeypatch.undo()
    assert rows() == through and (tmp_path / "i" / "blocks" / "_SUCCESS").exists()


def test_a_task_hands_on_its_best_rows(spark, monkeypatch):
    """The same best rows and ties as by sorting all, and no more than k rows for a query handed on."""
    monkeypatch.setattr(topk, "CELLS", 40)
    rng = np.random.default_rng(8)
    s = np.round(rng.normal(size=(4, 1000)), 2)
    s[0, ::3], s[1] = -np.inf, 1.0
    rows = spark.createDataFrame([(i,) for i in range(1000)], "doc_id long").coalesce(1)
    ids = pa.array(["a", "b", "c", "d"])
    for above in (-np.inf, 0.0):
        out = topk.top_rows(rows, ids, lambda b: s[:, b.column(0).to_numpy()], 5, "long", "string", above)
        got = {(r.query_id, r.rank, r.doc_id) for r in topk.ranked(out, 5, "doc_id").collect()}
        assert got == {(ids[q].as_py(), n, int(d)) for q in range(4) for n, d in enumerate(np.lexsort((np.arange(1000), -s[q]))[:5])}
        assert out.count() == 20


def test_index_is_shuffled_once(spark, tmp_path, monkeypatch):
    """Postings are dealt to buckets once, before lists are made."""
    calls = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "sortWithinPartitions", lambda self, *c, f=frame.sortWithinPartitions: calls.append(self._jdf.queryExecution().executedPlan().toString()) or f(self, *c))
    retrieval.bm25_index(spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string"), path=str(tmp_path / "i"))
    assert calls[-1].count("Exchange hashpartitioning") == 1


def test_vectors_of_few_texts_are_held(spark, monkeypatch):
    """Vectors of tokens are asked for in small groups of pairs, and batches are small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = spark.createDataFrame([(i, f"word{i} same", f"same word{i % 7}") for i in range(300)], "i long, a string, b string").coalesce(1)

    def provider(texts):
        assert len(texts) <= 128
        return udfs.trigram_vectors(texts)

    got = {r.i: r.s for r in rows.select("i", udfs.token_match(provider)("a", "b").alias("s")).collect()}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    want = udfs.greedy_match_block(*(udfs.trigram_vectors([x for _, *p in sorted((r.i, r.a, r.b) for r in rows.collect()) for x in [p[k]]]) for k in (0, 1)))
    assert all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want))


def test_sets_are_not_shuffled_for_classes(spark, monkeypatch):
    """Only sets that are in a pair meet others: the tables that are written hold no set of a text without a near one."""
    rng = random.Random(8)
    alone = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 9)) for _ in range(60)) for _ in range(30)]
    near = alone[0] + " and one more"
    docs = spark.createDataFrame(list(enumerate([*alone, near, near, alone[5]])), "id long, text string")
    written = []
    monkeypatch.setattr(dedup, "cut", lambda df, f=dedup.cut: written.append(f(df)) or written[-1])
    members, pairs = dedup.jaccard_classes(docs, "id", "text")
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 30)]
    assert {(r.rep, r.id) for r in members.where("rep <> id").collect()} == {(30, 31), (5, 32)} and members.count() == 33
    assert sorted(t.count() for t in written if "s" in t.columns) == [2, 33]
