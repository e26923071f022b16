from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["text_normalize", "bm25_topk", "rrf_topk", "cascade_batch", "drop_reason_counts", "eval_rollup", "stratified_sample", "kb_gates", "context_prompts", "bm25_saved_index", "recall_mrr_ablation", "cache_fuzzy", "eval_run", "promote_gates", "dedup_greedy", "damaged_lines", "judgement_upsert", "heading_starts", "synthesis_prompts"]


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_their_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    want = sorted(map(repr, c.sql(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()))
    assert got == want
