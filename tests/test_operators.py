from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import cache, cascade, dedup, metrics, promote, prompts, ranks, retrieval, sampling, text_quality, validate
from millrace.sources import readers, sinks


def test_cleaning_order(spark):
    raw = "Title ........ 12\n3GPP TS 36.300 version 1\n\n\n\nBody  with\ttabs \n"
    got = spark.createDataFrame([(raw,)], "t string").select(text_quality.clean_text(F.col("t"))).first()[0]
    assert got == "Title\n\nBody with tabs"


@pytest.mark.parametrize(("body", "dense"), [("word " * 60, True), ("word " * 20, False), ("a." * 200, False), ("123 4567 " * 60, False), ("Chapter one 12\n" * 20, False), ("", False)])
def test_density(spark, body, dense):
    assert spark.createDataFrame([(body,)], "t string").select(text_quality.is_dense(F.col("t"))).first()[0] is dense


def test_references_and_markers(spark):
    rows = spark.createDataFrame([(1, "[1] a\n[2] b\ntext"), (2, "text\ntext\n[1] a"), (3, ""), (4, "x All rights reserved")], "i int, t string")
    got = {r.i: (r.r, r.b) for r in rows.select("i", text_quality.is_references(F.col("t")).alias("r"), text_quality.is_boilerplate(F.col("t")).alias("b")).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, False), 4: (False, True)}


def test_body_start(spark):
    rows = [(1, 0, "Foreword"), (1, 1, "3.1Definitions\n\n3.2Symbols"), (1, 2, "4.1General\n\ntext"), (1, 3, "5.1More"), (2, 0, "no heading"), (3, 0, "4.1Split34\n\n4.2: colon"), (3, 1, "5.1Real")]
    got = {r.doc: r.start for r in text_quality.body_start(spark.createDataFrame(rows, "doc int, idx int, chunk string")).collect()}
    assert got == {1: 2, 2: 0, 3: 0}


DOCS = [(1, "alpha beta gamma"), (2, "beta beta delta"), (3, "epsilon"), (4, "")]


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    asked = spark.createDataFrame([("q1", "beta"), ("q2", "nothing here"), ("q3", "beta beta")], "query_id string, query string")
    hits = {(r.query_id, r.doc_id): (r.score, r["rank"]) for r in retrieval.bm25(asked, docs, 5).collect()}
    assert set(hits) == {("q1", 1), ("q1", 2), ("q3", 1), ("q3", 2)}
    assert hits["q1", 2][1] == 0 and hits["q3", 2][0] == pytest.approx(2 * hits["q1", 2][0])
    assert retrieval.bm25(asked, docs.limit(0), 5).count() == 0
    assert retrieval.bm25(asked, docs, 1).where("query_id = 'q1'").count() == 1
    assert retrieval.bm25(asked, docs, 5, idf="okapi_floor").count() >= 0


def test_fusion_keeps_first_order(spark):
    s = "query_id string, doc_id string, rank int"
    one = spark.createDataFrame([("q", "a", 0), ("q", "x", 1)], s)
    two = spark.createDataFrame([("q", "b", 0), ("q", "c", 1), ("q", "x", 2)], s)
    got = {r.doc_id: (r.score, r["rank"]) for r in retrieval.fuse([one, two]).collect()}
    assert got["x"][0] == pytest.approx(1 / 62 + 1 / 63) and got["x"][1] == 0
    assert got["a"][1] == 1 and got["b"][1] == 2
    assert retrieval.fuse([one.limit(0), two.limit(0)]).count() == 0


def test_dense_keeps_negative_scores(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "doc_id long, v array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, q array<float>")
    assert [(r.doc_id, r.score) for r in retrieval.dense(q, v, 9).orderBy("rank").collect()] == [(1, 1.0), (2, -1.0)]
    assert retrieval.dense(q.limit(0), v).count() == 0


CACHE = [("What is X?", "first", "s", 0), ("what is x", "last", "s", 1), ("Bearer setup procedure", "b", "t", 2)]


def test_cache_steps(spark):
    keys = spark.createDataFrame(CACHE, "question string, answer string, source string, ordinal long")
    asked = spark.createDataFrame([(1, " What is X? "), (2, "WHAT is x!!"), (3, "procedure bearer setup"), (4, "unrelated words")], "query_id long, query string")
    got = {r.query_id: (r.match_type, r.answer, r.confidence) for r in cache.lookup(asked, keys).collect()}
    assert got[1] == ("exact", "first", 1.0) and got[2] == ("normalized", "last", 0.95)
    assert got[3][0] == "fuzzy" and got[3][2] == pytest.approx(0.95)
    assert got[4] == (None, None, 0.0)
    assert cache.upsert(keys, spark.createDataFrame([("What is X?", "new", "s", 9)], keys.schema)).where("answer = 'new'").count() == 1


def test_cascade_carries_context_and_keeps_queries(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, query string")
    seen = []

    def first(p):
        return p.select("query_id", F.when(F.col("query_id") == 1, "").alias("answer"), F.lit(0.9).alias("confidence"), F.when(F.col("query_id") == 2, F.array(F.lit("hint"))).otherwise(F.array().cast("array<string>")).alias("candidates"))

    def second(p):
        seen.extend((r.query_id, r.context) for r in p.collect())
        return p.select("query_id", F.when(F.col("query_id") == 2, "two").alias("answer"), F.lit(0.6).alias("confidence"))

    got = {r.query_id: r for r in cascade.route(asked, [cascade.Tier("cache", first), cascade.Tier("generative", second)]).collect()}
    assert got[1].answer == "" and got[1].answered_by == "cache" and got[2].answered_by == "generative"
    assert got[3].answered_by == "none" and got[3].answer == cascade.NO_ANSWER and got[3].tier_trace == ["cache", "generative"]
    assert sorted(seen) == [(2, ["hint"]), (3, None)]
    with pytest.raises(ValueError):
        cascade.route(asked, [])


def test_greedy_is_not_components(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    assert {r.id: r.kept for r in dedup.greedy(chain).collect()} == {1: True, 2: False, 3: True, 5: True, 6: False}
    assert dedup.greedy(chain.limit(0)).count() == 0


def test_jaccard_pairs_are_exact(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(30)) for _ in range(6)]
    texts = []
    for b in base:
        for k in (0, 1, 2):
            w = b.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    texts += ["", "  ", "short one", "short one"]

    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {t.lower()}

    s = [shingles(t) for t in texts]
    want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.6}
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    members, pairs = dedup.jaccard_classes(docs, "id", "t", 0.6)
    of = {r.id: r.rep for r in members.collect()}
    near = {(r.a, r.b) for r in pairs.collect()}
    # Every pair of ids is a pair of classes or lies within one, and none else.
    assert {(i, j) for i in of for j in of if i < j and (of[i] == of[j] or (min(of[i], of[j]), max(of[i], of[j])) in near)} == want
    kept = {r.id: r.kept for r in dedup.deduplicate(docs, "id", "t", 0.6).collect()}
    stay: list = []
    for i in range(len(texts)):
        if not any((j, i) in want for j in stay):
            stay.append(i)
    assert [i for i in sorted(kept) if kept[i]] == stay


def test_a_class_of_many_equal_texts_is_one_node(spark):
    n = 100_000
    same, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(39)) + " changed"
    docs = spark.range(n).select("id", F.when(F.col("id") % 1000 == 7, F.lit(other)).otherwise(F.lit(same)).alias("t")).unionByName(spark.createDataFrame([(n, "alone here"), (n + 1, None)], "id long, t string"))
    members, pairs = dedup.jaccard_classes(docs, "id", "t")
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 7)] and members.count() == n + 1
    assert sorted(r.id for r in dedup.deduplicate(docs, "id", "t").where("kept").collect()) == [0, n, n + 1]


def test_signatures_estimate_similarity(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    other = base[:225] + [f"v{i}" for i in range(75)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base).upper()), (4, None), (5, "short"), (6, "")], "id long, t string")
    sig = {r.id: r.sig for r in dedup.signatures(docs, "id", "t", 512).collect()}
    assert set(sig) == {1, 2, 3, 5, 6} and sig[1] == sig[3] and len(sig[5]) == 512 and len(set(sig[1])) == 512
    true = 221 / (296 + 296 - 221)
    assert np.mean(np.array(sig[1]) == np.array(sig[2])) == pytest.approx(true, abs=0.07)
    hashes = spark.createDataFrame([(1, " ".join(base))], "id long, t string").select(F.explode(F.transform(dedup.shingle_set(F.col("t")), lambda x: F.xxhash64(x)))).collect()
    h = np.array([r[0] for r in hashes], np.int64).view(np.uint64)
    assert sig[1] == [int(dedup._mixed(h, s).min().view(np.int64)) for s in range(1, 513)]
    met = {(r.id, r.centre) for r in dedup.minhash_candidates(docs, "id", "t").collect()}
    assert (3, 1) in met and not any(i == 5 for i, _ in met)


@pytest.mark.parametrize("few", [1, 3, 4096])
def test_percentiles_by_selection(spark, few, monkeypatch):
    monkeypatch.setattr(ranks, "STEPS", 4)
    rng = random.Random(few)
    data = [("a", rng.gauss(0, 1) * 10 ** rng.randint(-3, 6)) for _ in range(200)] + [("b", float(rng.randint(0, 3))) for _ in range(100)] + [("c", 5.0), ("d", None), (None, 1.5), (None, -2.0), ("e", float("inf")), ("e", 1.0), ("a", 1e300)]
    df = spark.createDataFrame(data, "k string, x double").repartition(4)
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r.k: [r[f"p{i}"] for i in range(5)] for r in ranks.percentiles(df, ["k"], "x", shares, few).collect()}
    assert "d" not in got
    for k in ("a", "b", "c", None):
        xs = sorted(x for j, x in data if j == k)
        assert got[k] == pytest.approx(np.percentile(xs, [100 * p for p in shares]).tolist(), rel=1e-12)
    assert got["e"][0] == 1.0 and got["e"][4] == 1.7976931348623157e308


def test_percentile_plans_hold_no_group_in_one_task(spark):
    df = spark.range(50_000).select((F.col("id") % 3).alias("k"), F.rand(3).alias("x"))
    out = metrics.latency(df, "x", "k")
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 3


@pytest.mark.parametrize("one_list", [1, 20, 100_000])
def test_stratified_sample_by_ranges(spark, one_list):
    data = [(i, "abc"[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]) for i in range(300)] + [(400 + i, None) for i in range(20)] + [(7, "a")]
    rows = spark.createDataFrame(data, "id long, s string")
    order = lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest()
    sizes = {s: [i for i, t in data if t == s] for s in ("a", "b", "c", None)}
    k = {r.stratum: r.k for r in sampling.apportion(rows.groupBy(F.col("s").alias("stratum")).agg(F.count("*").alias("n"), F.min("id").alias("first")), 60).collect()}
    want = sorted((i, s or "") for s, ids in sizes.items() for i in sorted(ids, key=lambda i: (order(i), i))[: k[s]])
    out = sampling.stratified_sample(rows, "id", "s", 60, one_list=one_list)
    assert sorted((r.id, r.s or "") for r in out.collect()) == want


@pytest.mark.parametrize("budget", [1, 50, 2000, 10**9])
def test_one_budget_by_ranges(spark, budget):
    rng = random.Random(budget)
    data = [(f"k{i:04d}", rng.randint(0, 30)) for i in range(200)]
    got = sampling.within_budget(spark.createDataFrame(data, "id string, used long").repartition(5), "used", budget, "id", range_rows=20)
    keep, before = [], 0
    for i, (k, u) in enumerate(data):
        if i and before + before / i > budget:
            break
        keep.append(k)
        before += u
    assert sorted(r.id for r in got.collect()) == keep
    assert sampling.within_budget(spark.createDataFrame(data[:0], "id string, used long"), "used", budget, "id").count() == 0


def test_grounding_counts_repeats(spark):
    row = spark.createDataFrame([("timer timer starts", "the Timer runs")], "a string, c string")
    assert row.select(validate.grounding(F.col("a"), F.col("c"))).first()[0] == pytest.approx(2 / 3)
    assert row.select(validate.grounding(F.lit("the of"), F.col("c"))).first()[0] == 0.0


def test_utility_reasons(spark):
    long = "the bearer " + "word " * 15
    row = spark.createDataFrame([("Which timer?", long), ("What version is the document?", "See it."), ("q", "described in clause 4.1 and specified in sections 5.2")], "q string, a string")
    got = [(r.u, len(r.r)) for r in row.select(validate.utility(F.col("q"), F.col("a")).alias("u"), validate.utility_reasons(F.col("q"), F.col("a")).alias("r")).collect()]
    assert got == [(1.0, 0), (0.2, 3), (0.2, 3)]


def test_gates_have_opposite_defaults(spark):
    row = spark.createDataFrame([(None, 0.9, 0.9), (True, 0.6, 0.6), (True, 0.59, 0.9)], "f boolean, g double, u double")
    assert [r[0] for r in row.select(validate.kb_gate(F.col("f"), F.col("g"), F.col("u"))).collect()] == ["not_in_chunk", None, "low_grounding"]


def test_promotion(spark):
    fifty = "word " * 50
    rows = [(0, "How long is the timer?", fifty, 0.9, None), (1, "How long is the timers?", fifty, 0.9, None), (2, "Quite another thing", fifty, 0.60, True), (3, "No answer in chunk", fifty, 0.9, False), (4, "Too short", "word " * 49, 0.9, None), (5, "Unsure", fifty, 0.59, None), (6, "Live question here", fifty, 0.9, None)]
    c = spark.createDataFrame(rows, "ordinal long, question string, answer string, confidence double, answer_in_chunk boolean")
    out = promote.promote(c, spark.createDataFrame([("live question here!",)], "question string"))
    assert {r.ordinal: r.gate for r in out.collect()} == {0: None, 1: "duplicate", 2: None, 3: "skipped", 4: "length", 5: "confidence", 6: "duplicate"}
    assert promote.report(out).first().n_evaluated == 6


def test_near_questions_against_all_pairs(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(40)]

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    df = spark.createDataFrame(list(enumerate(texts)), "id long, q string")
    empty = min((i for i, t in enumerate(texts) if not t), default=None)  # it stands for all empty ones of the left side
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if (lev(a, b) <= 0.3 * max(len(a), len(b))) and (a or i == empty)}
    assert {(r.a, r.b) for r in promote.near_questions(df, df).collect()} == want


def test_sampling(spark):
    rows = spark.range(100).select(F.col("id"), F.when(F.col("id") < 70, "a").when(F.col("id") < 95, "b").otherwise("c").alias("s"))
    small, large = ({r.id for r in sampling.nested_sample(rows, "id", n).collect()} for n in (10, 30))
    assert small < large
    strata = sampling.stratified_sample(rows, "id", "s", 20).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in strata} == {"a": 14, "b": 5, "c": 1}
    assert sampling.stratified_sample(rows, "id", "s", 500).count() == 100
    budget = spark.createDataFrame([(i, 10) for i in range(10)], "i int, used int")
    assert sampling.within_budget(budget, "used", 35, "i").count() == 3
    assert sampling.within_budget(budget, "used", 0, "i").count() == 10
    ids = sampling.running_ids(rows, "synth_%05d", 1, "id").orderBy("id").select("id").collect()
    assert len({r[0] for r in ids}) == 100


def test_percentiles_and_distribution(spark):
    rows = spark.createDataFrame([("cache", 1.0), ("cache", 2.0), ("generative", 100.0)], "answered_by string, x double")
    r = metrics.latency(rows, "x").first()
    assert (r.p50, r.latency_max) == (2.0, 100.0) and r.p95 == pytest.approx(90.2)
    assert metrics.latency(rows.limit(0), "x").first().p99 == 0.0
    assert {x.tier: x.n for x in metrics.tier_distribution(rows).collect()} == {"cache": 2, "retrieval": 0, "generative": 1, "none": 0}
    for n, want in {1: (0, 0, 0), 2: (0, 1, 1), 5: (1, 2, 3)}.items():
        q = metrics.nearest_rank_quartiles(spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("v0")), "v0", "k").first()
        assert (q.p25, q.p50, q.p75) == want


def test_prompts(spark):
    def prompt(snippets):
        return spark.createDataFrame([("q", snippets)], "q string, s array<string>").select(prompts.context_prompt(F.col("q"), F.col("s"), 10)).first()[0]

    assert prompt(None) == "q" and prompt([]) == "q" and prompt(["x" * 11]) == "q"
    assert "bbb" not in prompt(["a" * 8, "b" * 3, "c"]) and "c" not in prompt(["a" * 8, "b" * 3, "c"]).split("Question")[0].replace("Context", "")


def test_readers_and_sinks(spark, tmp_path):
    p = tmp_path / "rows.jsonl"
    p.write_text('{"id": "a"}\n\n{"id": "b"}\n{"id": \n')
    good, bad = readers.tolerant_lines(spark, str(p), "id string")
    assert (good.count(), bad.count()) == (2, 1)
    assert readers.dropping_lines(spark, str(p), "id string").count() == 2
    with pytest.raises(Exception):
        readers.strict_lines(spark, str(p), "id string").collect()
    good, bad = readers.tolerant_lines(spark, str(tmp_path / "none"), "id string")
    assert (good.count(), bad.count()) == (0, 0)
    c = tmp_path / "cache.json"
    c.write_text(json.dumps({"q": {"answer": "a", "source": "s", "added": "2024-01-02"}, "r": {"answer": "b", "source": "t"}}))
    assert {r.question: r.added is None for r in readers.cache_file(spark, str(c)).collect()} == {"q": False, "r": True}
    assert readers.judgements(spark, str(tmp_path / "no.json")).count() == 0
    sinks.write_manifest(spark, str(tmp_path / "m"), "a/b.jsonl", 3, "e", "ff")
    m = readers.manifest(spark, str(tmp_path / "m"))
    assert m["kb_filename"] == "b.jsonl" and sinks.manifest_matches(m, "b.jsonl", "ff", 3) == (True, "hash")
    assert readers.manifest(spark, str(tmp_path / "missing")) is None


def test_archives(spark, tmp_path):
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("word/document.xml", body)
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.docx", inner.getvalue())
    (tmp_path / "y.zip").write_bytes(b"broken")
    got = {r.path[-5:]: r.text for r in readers.archived_texts(spark, str(tmp_path)).collect()}
    assert got == {"x.zip": "One\n\na\tb", "y.zip": None}


def test_log_stream(spark, tmp_path):
    from millrace.streaming import query_log

    rows = [{"query_id": str(i), "ts": f"2024-01-01T0{i % 3}:10:00", "query": "q", "answered_by": "cache", "confidence": 1.0, "latency_ms": 5.0} for i in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    query_log.to_table(query_log.tiers_by_window(query_log.read_log(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.n for r in closed) == [2, 2]


def test_evaluation_run_and_judgements(spark):
    from millrace.operators import evaluate

    items = spark.createDataFrame([("a", "the cat sat", "cache"), ("b", "x", "retrieval")], "query_id string, reference string, expected_tier string")
    results = spark.createDataFrame([("a", "the cat sat", "cache", 1.0)], "query_id string, answer string, answered_by string, confidence double")
    got = {r.query_id: r for r in evaluate.facts(items, results).collect()}
    assert got["a"].rouge_l == 1.0 and got["a"].tier_match and got["b"].answered_by == "none" and got["b"].rouge_l == 0.0
    judged = spark.createDataFrame([("a", "d1", True), ("z", "d2", False)], "query_id string, doc_id string, relevant boolean")
    known, lost = evaluate.label_overlap(items, judged)
    assert (known.count(), lost.count()) == (1, 1)
    hits = spark.createDataFrame([("a", "d1"), ("a", "d3")], "query_id string, doc_id string")
    assert [r.doc_id for r in evaluate.to_judge(hits, judged).collect()] == ["d3"] and evaluate.to_judge(hits, judged, again=True).count() == 2
    new = evaluate.judge(judged, spark.createDataFrame([("a", "d1", False)], judged.schema))
    assert new.where("query_id = 'a'").first().relevant is False and new.count() == 2
    assert "rouge_l" in evaluate.render(evaluate.facts(items, results))


def test_pairs_are_generated_and_gated(spark):
    from millrace.operators import evaluate
    from millrace.operators.providers import Backend

    def model(prompt: str) -> str:
        if "silent" in prompt:
            return "[]"
        if "broken" in prompt:
            return "no json"
        return '```json\n[{"question": "Which timer?", "answer": "' + "bearer timer starts " * 6 + '"}, {"question": " ", "answer": "x"}]\n```'

    chunks = spark.createDataFrame([("c1", "s", "the bearer timer starts here"), ("c2", "s", "silent"), ("c3", "s", "broken")], "chunk_id string, source string, chunk string")
    rows = evaluate.generate_pairs(chunks, [Backend("m", model)]).collect()
    assert [(r.id, r.gate, r.grounding_score) for r in rows] == [("cand_c1_00", None, 1.0)]


def test_newest_archive_and_hashes_of_files(spark, tmp_path):
    files = spark.createDataFrame([("36.300", "/a/36300-a10.zip"), ("36.300", "/b/36300-j20.zip"), ("36.300", "/z/36300-b00.zip"), ("24.301", "24301-k00.zip")], "spec string, path string")
    assert {r.spec: r.path for r in readers.newest_archives(files).collect()} == {"36.300": "/b/36300-j20.zip", "24.301": "24301-k00.zip"}
    data = bytes(range(256)) * 5000
    (tmp_path / "kb.bin").write_bytes(data)
    (tmp_path / "small.bin").write_bytes(b"abc")
    got = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in readers.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {"kb.bin": hashlib.sha256(data[:1_000_000]).hexdigest(), "small.bin": hashlib.sha256(b"abc").hexdigest()}


def test_rows_of_the_configured_file(spark, tmp_path):
    from millrace import config

    f = tmp_path / "kb.jsonl"
    f.write_text('{"id": "a"}\n{"id": "b"}\nbroken {\n[1]\n\n{"id": "c"}\n')
    (tmp_path / "other.jsonl").write_text('{"id": "z"}\n')
    env = {"MILLRACE__KB_PATH": str(f)}
    now = config.Current(env=env)
    assert readers.configured_rows(spark, now.get().kb_path) == 3
    env["MILLRACE__KB_PATH"] = str(tmp_path / "missing.jsonl")
    assert now.get().kb_path == str(f) and now.get(again=True).kb_path.endswith("missing.jsonl")
    assert readers.configured_rows(spark, now.get().kb_path) == 0 and readers.configured_rows(spark, "") == 0


def test_promoted_pairs_and_reports(spark, tmp_path):
    from datetime import datetime, timezone

    from millrace.operators import evaluate

    rows = spark.createDataFrame([(1, "q1", "a " * 60, 0.9, None), (2, "q2", "short", 0.9, None), (3, "another question here", "b " * 60, 0.1, None), (4, "skip", "c", 0.9, False)], "ordinal long, question string, answer string, confidence double, answer_in_chunk boolean")
    done = promote.promote(rows, spark.createDataFrame([], "question string"))
    path = str(tmp_path / "additions")
    for hour in (1, 2):
        sinks.append_promoted(done, path, datetime(2024, 1, 1, hour, tzinfo=timezone.utc))
    kept = spark.read.json(path).collect()
    assert sorted((r.question, r.promoted_at) for r in kept) == [("q1", "2024-01-01T01:00:00+00:00"), ("q1", "2024-01-01T02:00:00+00:00")]
    report = json.loads(promote.report_json(done, "candidates.jsonl", "2024-01-01T00:00:00+00:00").first()["value"])
    assert report["counts"]["n_promoted"] == 1 and report["counts"]["n_evaluated"] == 3 and {r["gate"]: r["n"] for r in report["rejected"]} == {"confidence": 1, "length": 1, "skipped": 1}
    assert "promoted" in evaluate.render_promotion(promote.report(done)) and report["source"] == "candidates.jsonl"
    facts = spark.createDataFrame([("cache", 1.0, 1.0, 0.1), ("none", 0.0, 0.0, 2.0)], "answered_by string, rouge_l double, match_f1 double, latency_sec double")
    shown = evaluate.render_run(metrics.evaluation(facts), metrics.tier_distribution(facts), metrics.backend_distribution(facts.withColumn("backend", F.lit("primary"))))
    assert shown.index("overall") < shown.index("cache") < shown.index("Answered by") < shown.index("Backends") and "primary" in shown
    whole = sinks.report_json(metrics.evaluation(facts).where("tier = 'overall'"), {"tiers": metrics.tier_distribution(facts)}, facts.withColumn("query_id", F.lit("x")))
    out = str(tmp_path / "report")
    whole.coalesce(1).write.text(out)
    read = json.loads(spark.read.text(out).first()["value"])
    assert read["overall"]["n"] == 2 and len(read["per_query"]) == 2 and len(read["tiers"]) == 4
    assert metrics.evaluation(facts.limit(0)).first().n == 0


def test_system_prompts(spark):
    got = spark.range(1).select(prompts.with_system(F.lit("Q?"), "synthesis")).first()[0]
    assert got == prompts.SYSTEM["synthesis"] + "\n\nQ?" and set(prompts.SYSTEM) == {"synthesis", "generative", "candidates"}


def test_texts_that_hold_a_query(spark):
    docs = spark.createDataFrame([(1, "xx the quick brown fox yy"), (2, "the quick brown foxes"), (3, "quick the brown fox"), (4, None), (5, "a.b ?! c"), (6, "concatenate")], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "the quick brown fox"), ("b", "quick"), ("c", "?!"), ("d", "cat"), ("e", "no such words here"), ("f", "he quick brown f")], "query_id string, query string")
    got = {(r.query_id, r.doc_id) for r in retrieval.containing(asked, docs, retrieval.bm25_index(docs)).collect()}
    assert got == {("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 5), ("d", 6), ("f", 1), ("f", 2)}
