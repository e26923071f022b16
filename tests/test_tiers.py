"""Search over written indexes, the tiers, evaluation runs, generation, settings and logs."""

from __future__ import annotations

import io
import json
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import config, storage
from millrace.functions.udfs import hashed_terms, token_set_ratio
from millrace.log import logger
from millrace.operators import cache, cascade, evaluate, metrics, providers, retrieval, sampling, tiers, topk
from millrace.operators.chunking import chunk_text, spans
from millrace.sources import ledger, readers, sinks

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "the", "of"]


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))), f"s{i % 3}") for i in range(n)]


def brute_bm25(query, docs, floor=False):
    texts = {i: t.split() for i, t, *_ in docs}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    df = {w: sum(w in t for t in texts.values()) for w in WORDS}
    idf = {w: math.log((n - d + 0.5) / (d + 0.5) + (0 if floor else 1)) for w, d in df.items() if d}
    if floor:
        low = 0.25 * sum(idf.values()) / len(idf)
        idf = {w: low if v < 0 else v for w, v in idf.items()}
    out = {}
    for i, t in texts.items():
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in query.split() if w in idf and w in t)
        if s > 0:
            out[i] = s
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))


@pytest.mark.parametrize("floor", [False, True])
def test_saved_index_against_brute_force(spark, tmp_path, monkeypatch, floor):
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 4)  # long lists in several blocks
    monkeypatch.setattr(retrieval, "BUCKETS", 3)
    monkeypatch.setattr(retrieval, "BUCKET_ENTRIES", 100)
    docs = corpus(200)
    retrieval.bm25_index(spark.createDataFrame(docs, "doc_id long, text string, source string"), path=str(tmp_path / "index"))
    index = retrieval.load_index(spark, str(tmp_path / "index"))
    asked = [("a", "alpha beta"), ("b", "the of the"), ("c", "unknown"), ("d", ""), ("e", "zeta"), ("f", "eps gamma"), ("g", "the of alpha alpha"), ("h", "the"), ("i", "beta the of eps zeta gamma")]
    hits = retrieval.bm25_search(index, spark.createDataFrame(asked, "query_id string, query string"), 7, "okapi_floor" if floor else "documented")
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 9)))
    for q, text in asked:
        assert got.get(q, []) == [(i, round(s, 9)) for i, s in brute_bm25(text, docs, floor)[:7]]


def test_dense_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "DENSE_BLOCK", 3)
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (50, 4)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [1.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, v array<double>").repartition(5)
    q = vectors.where("doc_id < 10").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    got = {(r.query_id, r["rank"]): r.doc_id for r in retrieval.dense(q, vectors, 6, exclude_self=True).collect()}
    for i in range(10):
        want = sorted((j for j in range(50) if j != i), key=lambda j: (-float(v[i] @ v[j]), j))[:6]
        assert [got[i, k] for k in range(6)] == want


def test_the_rank_is_cut_before_the_shuffle(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("query_id"), F.rand(1).alias("score"))
    plan = topk.ranked(rows, 5, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_dense_index_is_exact_and_skips(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "DENSE_BLOCK", 5)
    monkeypatch.setattr(retrieval, "ORDINAL_ROWS", 50)
    rng = random.Random(9)
    centres = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in centres[i % 8]]) for i in range(400)] + [(400, None), (401, [1.0]), (402, [float("nan")] * 6), (403, [0.0] * 6)]
    rows += [(500 + i, rows[i][1]) for i in range(20)]  # ties
    v = spark.createDataFrame(rows, "doc_id long, v array<double>")
    retrieval.dense_index(v, str(tmp_path / "dense"), clusters=8)
    index, report = retrieval.load_dense_index(spark, str(tmp_path / "dense")), {}
    q = v.where("doc_id % 40 = 3").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    got, want = retrieval.dense_search(q, index, 7, True, report), retrieval.dense(q, v.where("doc_id <> 402"), 7, True)
    rows_of = lambda d: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in d.collect())
    assert rows_of(got) == rows_of(want) and report["skipped"] > 0.5
    assert sorted(r.ordinal for r in index.vectors.select("ordinal").collect()) == list(range(421))
    plan = index.vectors.where(F.col("cluster").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster" in plan
    assert retrieval.dense_search(q.limit(0), index).count() == 0
    empty = retrieval.dense_index(v.limit(0))
    assert retrieval.dense_search(q, empty).count() == 0


def test_sparse_search_reads_asked_folders_only(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BUCKET_ENTRIES", 100)
    docs = corpus(300)
    index = retrieval.bm25_index(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    asked = spark.createDataFrame([("a", "alpha"), ("b", "alpha zeta")], "query_id string, query string")
    seen = []
    real = retrieval._bounds
    retrieval._bounds = lambda blocks, *rest: seen.append(blocks._jdf.queryExecution().executedPlan().toString()) or real(blocks, *rest)
    try:
        assert retrieval.bm25_search(index, asked, 3).count() == 6
    finally:
        retrieval._bounds = real
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", seen[0]) and len(index.folders(asked.withColumnRenamed("query", "t"), "t")) <= 2


def test_common_words_are_looked_up_and_not_read(spark, monkeypatch):
    """A rare word decides; the word that all texts have is no essential list."""
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 16)
    rng = random.Random(5)
    docs = [(i, "the " * rng.randint(1, 4) + ("rare " * (1 + i % 3) if i % 9 == 0 else "other ") + " ".join(rng.choice(WORDS[:5]) for _ in range(4)), "s") for i in range(400)]
    index = retrieval.bm25_index(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    asked = spark.createDataFrame([("a", "the rare")], "query_id string, query string")
    weights = retrieval._idf(index, spark.createDataFrame([("a", "the", 1), ("a", "rare", 1)], "query_id string, token string, times long"), "documented")
    bounded = {r.token: r.essential for r in retrieval._bounds(index.blocks.where(F.col("token").isin("the", "rare")), weights, 5).collect()}
    assert bounded == {"the": False, "rare": True}
    hits = retrieval.bm25_search(index, asked, 5).orderBy("rank").collect()
    texts = {i: t.split() for i, t, _ in docs}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    score = lambda t: sum(math.log((n - d + 0.5) / (d + 0.5) + 1) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w, d in ((w, sum(w in x for x in texts.values())) for w in ("the", "rare")) if w in t)
    want = sorted(((-round(score(t), 9), i) for i, t in texts.items()))[:5]
    assert [(-round(r.score, 9), r.doc_id) for r in hits] == want


def test_key_index_is_searched_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "BLOCK", 2)  # several blocks of queries of near lengths
    keys = spark.createDataFrame([(k, f"a{i}", "s", i) for i, k in enumerate(["how to configure the radio network", "configure radio", "mobility management entity", "mobility managment entities here"])], "question string, answer string, source string, ordinal long")
    cache.key_index(keys, str(tmp_path / "keys"))
    asked = spark.createDataFrame([(1, "how to configur the radio network"), (2, "mobility managemnt entity"), (3, "entity mobility management"), (4, "nothing"), (5, "mobility managementt entity"), (6, "")], "query_id long, query string")
    got = {r.query_id: r for r in cache.fuzzy_lookup(asked, cache.load_key_index(spark, str(tmp_path / "keys"))).collect()}
    assert got[1].matched_key == "how to configure the radio network" and 90 <= got[1].score < 100 and got[3].score == 100 and set(got) == {1, 2, 3, 5}
    assert {r.query_id: r.score for r in cache.fuzzy_lookup(asked, keys).collect()} == {k: r.score for k, r in got.items()}


def test_fuzzy_lookup_is_exact(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeg") for _ in range(rng.randint(1, 9))) for _ in range(14)]
    keys = list(dict.fromkeys(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6))) for _ in range(60)))

    def typo(t):
        t = list(t)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(t) + 1)
            if rng.random() < 0.5:
                t.insert(i, rng.choice("abc "))
            elif len(t) > 1:
                t.pop(i % len(t))
        return "".join(t)

    asked = [(i, typo(rng.choice(keys))) for i in range(80)] + [(100, ""), (101, "configuration"), (102, "zzz")]
    keys += ["configurations", "ab"]
    df = spark.createDataFrame([(k, f"a{i}", "s", i) for i, k in enumerate(keys)], "question string, answer string, source string, ordinal long")
    q = spark.createDataFrame(asked, "query_id long, query string")
    index = {r.norm: r.question for r in cache.normalized_index(df).collect()}
    norm = {r.query_id: r.n for r in q.select("query_id", cache.normalize(F.col("query")).alias("n")).collect()}
    for threshold in (90.0, 80.0, 60.0):
        want = {}
        for i, n in norm.items():
            scored = [(-round(token_set_ratio(n, k), 9), question) for k, question in index.items() if token_set_ratio(n, k) >= threshold]
            if scored:
                want[i] = min(scored)
        got = {r.query_id: (-round(r.score, 9), r.matched_key) for r in cache.fuzzy_lookup(q, df, threshold).collect()}
        assert got == want
    assert 101 in want


def search_of(spark, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    encode = lambda c: hashed_terms(F.split(c, " "))
    vectors = storage.table_cut(d.select("doc_id", encode(F.col("text")).alias("v")), "v")
    return d, tiers.searcher(retrieval.bm25_index(d), vectors, d, encode)


def test_tiers_together(spark):
    def never(prompt):
        raise AssertionError("no backend may be asked")

    def busy(prompt):
        raise providers.RateLimited("busy")

    docs = [(1, "alpha beta gamma", "spec a"), (2, "delta eps", None), (3, "the of the of", "spec c")]
    d, search = search_of(spark, docs)
    pending = spark.createDataFrame([(1, "alpha beta gamma", None), (2, "alpha unknown words here", None)], "query_id long, query string, context array<string>")
    said = [providers.Backend("one", lambda p: p)]
    got = {r.query_id: r for r in tiers.retrieval_tier(search, d, said)(pending).collect()}
    assert got[1].answer.startswith("[spec a, chunk 1]:\nalpha beta gamma") and got[1].answer.endswith("Question: alpha beta gamma")
    details = json.loads(got[1].details)
    assert details["citations"][0] == {"doc_id": 1, "source": "spec a"} and details["backend"] == "one"
    assert {"doc_id": 2, "source": ""} in details["citations"]
    # Below the gate no backend is asked, and the candidates go on.
    assert got[2].answer is None and json.loads(got[2].details)["reason"] == "low_rerank_score" and "alpha beta gamma" in got[2].candidates
    strict = config.RetrievalSettings(min_rerank_score=999)
    none = tiers.retrieval_tier(search, d, [providers.Backend("x", never)], strict)(pending).collect()
    assert all(r.answer is None and r.candidates for r in none)
    failed = {r.query_id: r for r in tiers.retrieval_tier(search, d, [providers.Backend("x", busy)])(pending).collect()}
    assert json.loads(failed[1].details)["reason"] == "synthesis_failed" and failed[1].answer is None and failed[1].confidence > 0.5
    # The last tier always answers.
    made = {r.query_id: r for r in tiers.generative_tier(said)(pending.withColumn("context", F.when(F.col("query_id") == 1, F.array(F.lit("a fact"))))).collect()}
    assert made[1].answer == "Context:\na fact\n\nQuestion: alpha beta gamma" and made[1].confidence == 0.6 and made[2].answer == "alpha unknown words here"
    lost = tiers.generative_tier([providers.Backend("x", busy)])(pending).collect()
    assert all(r.answer == tiers.ALL_FAILED and r.confidence == 0.0 for r in lost)


def test_tiers_are_built_as_far_as_they_can(spark):
    keys = spark.createDataFrame([("What?", "that", "s", 0)], "question string, answer string, source string, ordinal long")
    names = lambda t: [x.name for x in t]
    backends = [providers.Backend("one", providers.echo)]
    assert names(tiers.build(config.Settings(), keys)) == ["cache"]
    assert names(tiers.build(config.Settings(), keys, backends=backends)) == ["cache", "generative"]
    assert names(tiers.build(config.Settings(enabled_tiers=("generative",)), keys, backends=backends)) == ["generative"]
    d, search = search_of(spark, corpus(20))
    every = tiers.build(config.Settings(), keys, search, d, backends)
    assert names(every) == ["cache", "retrieval", "generative"]
    items = evaluate.eval_items(spark, [("i1", "what", "that", "cache", []), ("i2", "qqq www", "nothing", "generative", [])])
    out = {r.query_id: r for r in evaluate.run(items, every).collect()}
    assert out["i1"].answered_by == "cache" and out["i1"].tier_match and out["i1"].rouge_l == 1.0
    assert out["i2"].answered_by == "generative" and out["i2"].backend == "one"
    assert evaluate.by_tier(items, "cache").count() == 1 and evaluate.committed_judgements(spark).count() == 0
    with pytest.raises(ValueError):
        evaluate.eval_items(spark, [("a", "", "", "cache", []), ("a", "", "", "cache", [])])
    with pytest.raises(ValueError):
        evaluate.eval_items(spark, [("a", "", "", "none", [])])


def test_results_outlive_a_second_look(spark):
    """A tier's answers are written once: whoever reads them again gets the same, though its generator never says the same twice."""
    asked = spark.createDataFrame([(i, "q") for i in range(5)], "query_id long, query string")
    out = cascade.route(asked, [cascade.Tier("generative", lambda p: p.select("query_id", F.uuid().alias("answer"), F.lit(0.6).alias("confidence")))])
    assert sorted(out.collect()) == sorted(out.collect())


def test_unreadable_answers_are_asked_for_again():
    said = iter(["no array", "still none", '[{"question": "q", "answer": "a"}]'])
    got = providers.until_readable([providers.Backend("one", lambda p: next(said))], "p")
    assert got["answer"].startswith("[") and got["tokens_used"] == 2 + 2 + 4
    calls = []
    nothing = providers.until_readable([providers.Backend("one", lambda p: calls.append(p) or "[]")], "p")
    assert nothing["answer"] == "[]" and len(calls) == 1
    calls.clear()
    never_read = providers.until_readable([providers.Backend("one", lambda p: calls.append(p) or "what")], "p")
    assert never_read["answer"] is None and len(calls) == 3 and never_read["tokens_used"] == 3


def test_generation_stops_at_the_quota_and_goes_on_later(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", "s", f"text {i} of the chunk") for i in range(12)], "chunk_id string, source string, chunk string")

    def spent(prompt):
        raise providers.QuotaExhausted("per day")

    def pair(prompt):
        return '[{"question": "What is it?", "answer": "It is text."}, {"question": "", "answer": "x"}]'

    path = str(tmp_path / "out")
    assert evaluate.generate_in_batches(chunks, [providers.Backend("one", spent)], path, 4, "run 1") < 4
    assert evaluate.candidates(spark, path).count() == 0 and evaluate.asked_chunks(spark, path).count() == 0
    first = chunks.where("chunk_id < 'c2'")
    assert evaluate.generate_in_batches(first, [providers.Backend("one", pair)], path, 2, "run 2") == 2
    n = evaluate.candidates(spark, path).count()
    evaluate.generate_in_batches(chunks, [providers.Backend("one", pair)], path, 2, "run 3")
    rows = evaluate.candidates(spark, path).collect()
    assert 0 < n < len(rows) == len({r.id for r in rows}) == 12 and {r.run_started_at for r in rows} == {"run 2", "run 3"}
    more = chunks.unionByName(spark.createDataFrame([("c99", "s", "new")], "chunk_id string, source string, chunk string"))
    evaluate.generate_in_batches(more, [providers.Backend("one", pair)], path, 1, "run 4", spark.createDataFrame([("c99",)], "source_chunk_id string"))
    assert evaluate.candidates(spark, path).count() == 12


def test_a_batch_that_fails_half_way_counts_once(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([(f"c{i}", "s", f"text {i} of the chunk") for i in range(30)], "chunk_id string, source string, chunk string")
    path = str(tmp_path / "out")
    backend = [providers.Backend("one", lambda p: "[]" if "text 7 " in p else '[{"question": "What is it?", "answer": "It is text."}]')]
    real, calls = evaluate.write_lines, []

    def failing(rows, to, *rest, **more):
        calls.append(to)
        real(rows, to, *rest, **more)
        if len(calls) == 4:  # the pairs of the second batch are written, its record isn't
            raise OSError("the driver dies here")

    monkeypatch.setattr(evaluate, "write_lines", failing)
    with pytest.raises(OSError):
        evaluate.generate_in_batches(chunks, backend, path, 3, "run 1")
    half = {r.source_chunk_id for r in evaluate.candidates(spark, path).collect()}
    assert 0 < len(half) < 29 and ledger.records(spark, path).count() == 1
    monkeypatch.setattr(evaluate, "write_lines", real)
    assert evaluate.generate_in_batches(chunks, backend, path, 3, "run 1") == 3
    rows = evaluate.candidates(spark, path).collect()
    assert sorted(r.source_chunk_id for r in rows) == sorted(f"c{i}" for i in range(30) if i != 7) and len({r.id for r in rows}) == 29
    assert evaluate.asked_chunks(spark, path).distinct().count() == 30  # an empty answer is one
    told = ledger.records(spark, path).collect()
    assert sorted(r.batch for r in told) == [1, 2, 3, 4] and sum(r.rows for r in told) == 29 and sum(r.asked for r in told) == 30
    assert evaluate.generate_in_batches(chunks, backend, path, 1, "run 2") == 1 and evaluate.candidates(spark, path).count() == 29


def test_a_limit_holds_for_the_whole_job():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    part = providers.share_of(6, 24)  # a quarter of a call a minute
    assert (part.calls, part.seconds) == (1, 240.0) and providers.share_of(60, 8).calls == 7
    part.clock, part.sleep = lambda: now[0], sleep
    tries = []

    def fails(prompt):
        tries.append(now[0])
        raise ValueError("no")

    got = providers.run_chain(providers.limited([providers.Backend("a", fails), providers.Backend("b", str.upper)], part), "p", sleep=lambda s: None)
    assert got["answer"] == "P" and tries == [0.0, 240.0, 480.0] and now[0] == 720.0  # retries and the second backend wait too


def test_providers_of_models(spark):
    with pytest.raises(TimeoutError):
        providers.with_timeout(lambda p: time.sleep(5) or "late", 0.05)("p")
    assert providers.with_timeout(str.upper, 5)("p") == "P"
    with pytest.raises(ValueError):
        providers.with_timeout(lambda p: int("x"), 5)("p")
    df = spark.createDataFrame([("abc", "ab"), (None, "x")], "q string, p string")
    vector = providers.encoder(lambda texts: [[len(t), 1] for t in texts], prefix="query: ")
    score = providers.pair_scorer(lambda a, b: [len(x) - len(y) for x, y in zip(a, b, strict=True)])
    got = df.select(vector(F.col("q")).alias("v"), score(F.col("q"), F.col("p")).alias("s")).collect()
    assert [(r.v, r.s) for r in got] == [([10.0, 1.0], 1.0), ([7.0, 1.0], -1.0)]


def test_settings_from_file_and_environment(tmp_path):
    f = tmp_path / "settings.json"
    f.write_text(json.dumps({"cache": {"fuzzy_threshold": 80}, "enabled_tiers": ["cache"]}))
    s = config.load(str(f), {"MILLRACE__RETRIEVAL__RRF_K": "30", "MILLRACE__CACHE__FUZZY_THRESHOLD": "85.5", "OTHER": "1"})
    assert s.cache.fuzzy_threshold == 85.5 and s.retrieval.rrf_k == 30 and s.enabled_tiers == ("cache",)
    assert config.load(env={}) == config.Settings()
    with pytest.raises(ValueError):
        config.load(env={"MILLRACE__CACHE__NAME": "1"})


def test_log_lines_are_objects():
    out = io.StringIO()
    log = logger("millrace.test", stream=out)
    assert logger("millrace.test") is log and len(log.handlers) == 1
    log.info("routed", extra={"tier": "cache", "n": 3})
    line = json.loads(out.getvalue())
    assert line["message"] == "routed" and line["tier"] == "cache" and line["n"] == 3 and line["level"] == "INFO"


def test_large_samples_are_cut_by_the_hash(spark):
    rows = spark.range(3000)
    for n in (0, 1, 700, 2999, 3000, 5000):
        small = sampling.nested_sample(rows, "id", n, one_list=10**6).collect()
        assert {r.id for r in sampling.nested_sample(rows, "id", n, one_list=-1).collect()} == {r.id for r in small}
    assert sampling.fraction_sample(rows, "id", 0.1).count() == 300


def test_bounded_reports(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("b", ["2"]), ("a", ["1", "3"])], "query_id string, doc_ids array<string>")
    sinks.write_judgements(rows, str(tmp_path / "j"))
    assert {r.query_id: r.doc_ids for r in readers.judgements(spark, str(tmp_path / "j")).collect()} == {"a": ["1", "3"], "b": ["2"]}
    merged = metrics.judged_union(spark.createDataFrame([("a", ["9"]), ("c", ["5"])], rows.schema), rows)
    assert {r.query_id: r.doc_ids for r in merged.collect()} == {"a": ["1", "3"], "b": ["2"], "c": ["5"]}
    monkeypatch.setattr(sinks, "MOST_ENTRIES", 1)
    with pytest.raises(ValueError):
        sinks.write_judgements(rows, str(tmp_path / "k"))


def naive_spans(lengths, gap, size, overlap):
    """Piece by piece, as the rule says."""
    out, first, extra = [], 0, 0
    run = lambda a, b: sum(lengths[a:b]) + gap * max(0, b - a - 1) + extra
    for i in range(1, len(lengths)):
        if run(first, i) + gap + lengths[i] > size:
            out.append((first, i))
            while first < i and run(first, i) > overlap:
                first += 1
            if first == i:
                extra += gap
    return [*out, (first, len(lengths))] if lengths else []


def test_spans_against_the_rule():
    rng = random.Random(7)
    for _ in range(3000):
        lengths, gap = [rng.randint(0, 30) for _ in range(rng.randint(0, 20))], rng.choice([0, 1, 2])
        size = rng.randint(1, 50)
        overlap = rng.randint(0, size)
        assert list(spans(lengths, gap, size, overlap)) == naive_spans(lengths, gap, size, overlap)
    # Nothing but white space is lost, and the order stays.
    text = "\n\n".join(". ".join("w%d x" % rng.randrange(99) for _ in range(rng.randint(1, 30))) for _ in range(30))
    parts = chunk_text(text, 120, 20)
    at = 0
    for p in parts:
        at = text.index(p.split()[0], max(0, at - 200))
    assert set(text.replace(".", " ").split()) == {w for p in parts for w in p.replace(".", " ").split()}
