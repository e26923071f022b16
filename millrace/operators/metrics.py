"""Evaluation and log aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import TIERS
from millrace.functions.scores import percent
from millrace.operators.ranks import percentiles
from millrace.storage import table_cut


def _four(c: Column, name: str) -> Column:
    return F.coalesce(F.round(c, 4), F.lit(0.0)).alias(name)


def _with_percentiles(rows: DataFrame, keys: Sequence[str], out: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """``out`` (one row for each group) with exact percentiles of a value, null where a group has none."""
    found = percentiles(rows, keys, value, list(shares.values()))
    found = found.select(*[F.col(k).alias(f"j_{i}") for i, k in enumerate(keys)], *[F.col(f"p{i}").alias(name) for i, name in enumerate(shares)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"j_{i}"))
    return out.join(found, same, "left").drop(*[f"j_{i}" for i in range(len(keys))])


LATENCY = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def latency(rows: DataFrame, seconds: str, *keys: str) -> DataFrame:
    """``keys ..`` with percentiles (linear interpolation), mean and bounds, in seconds to four digits; 0 for no rows."""
    out = rows.groupBy(*keys).agg(F.avg(seconds).alias("latency_mean"), F.min(seconds).alias("latency_min"), F.max(seconds).alias("latency_max"))
    out = _with_percentiles(rows, keys, out, seconds, LATENCY)
    return out.select(*keys, *[_four(F.col(c), c) for c in (*LATENCY, "latency_mean", "latency_min", "latency_max")])


def tier_distribution(rows: DataFrame, column: str = "answered_by") -> DataFrame:
    """Rows and share of every tier, those without rows too."""
    spark = rows.sparkSession
    tiers = spark.createDataFrame([(t, i) for i, t in enumerate(TIERS)], "tier string, ordinal int")
    counts = rows.groupBy(F.col(column).alias("c_tier")).agg(F.count("*").alias("c_n"))
    total = rows.agg(F.count("*").alias("total"))
    out = F.broadcast(tiers).join(counts, F.col("tier") == F.col("c_tier"), "left").crossJoin(F.broadcast(total))
    return out.select("tier", F.coalesce("c_n", F.lit(0)).alias("n"), percent(F.coalesce("c_n", F.lit(0)), F.col("total")).alias("pct"))


def evaluation(rows: DataFrame) -> DataFrame:
    """Quality and latency of all rows (tier 'overall') and of each tier that occurs; means and medians of both scores to four digits."""
    rows = table_cut(rows.select(F.explode(F.array(F.lit("overall"), "answered_by")).alias("tier"), "rouge_l", "match_f1", "latency_sec"), "facts")
    means = [F.avg("rouge_l").alias("rouge_l_mean"), F.avg("match_f1").alias("match_mean"), F.avg("latency_sec").alias("latency_mean"), F.min("latency_sec").alias("latency_min"), F.max("latency_sec").alias("latency_max")]
    overall = rows.sparkSession.createDataFrame([("overall",)], "tier string")  # is there without any row too
    out = overall.join(rows.groupBy("tier").agg(*means, F.count("*").alias("n")), "tier", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    out = _with_percentiles(rows, ["tier"], out, "rouge_l", {"rouge_l_median": 0.5})
    out = _with_percentiles(rows, ["tier"], out, "match_f1", {"match_median": 0.5})
    out = _with_percentiles(rows, ["tier"], out, "latency_sec", LATENCY)
    four = ("rouge_l_mean", "rouge_l_median", "match_mean", "match_median", *LATENCY, "latency_mean", "latency_min", "latency_max")
    return out.select("tier", *[_four(F.col(c), c) for c in four], "n")


def backend_distribution(rows: DataFrame) -> DataFrame:
    """Rows of each backend and their share of the rows with a model call, with the number of those."""
    called = rows.where(F.col("backend").isNotNull())
    total = called.agg(F.count("*").alias("n_llm_calls"))
    return called.groupBy("backend").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("backend", "n", percent(F.col("n"), F.col("n_llm_calls")).alias("pct"), "n_llm_calls")


def backend_of(tier: Column, synthesis: Column, generative: Column) -> Column:
    """The backend that a tier names: the synthesis of the retrieval tier, the generative tier's own."""
    return F.when(tier == "retrieval", synthesis).when(tier == "generative", generative)


def tier_match(answered_by: Column, expected: Column) -> Column:
    return answered_by == expected


def nearest_rank_quartiles(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The values at places n // 4, n // 2 and 3n // 4 of the ascending order, from 0.

    Distinct values are counted first; the places are then found among the counts, which are
    bounded by the values that lengths take and not by the rows.
    """
    counts = rows.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    by = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("vs"), F.sum("c").alias("n"))

    def at(place: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("v"))
        step = lambda s, x: F.struct((s["n"] + x["c"]).alias("n"), F.when(s["v"].isNull() & (s["n"] + x["c"] > place), x["v"].cast("long")).otherwise(s["v"]).alias("v"))
        return F.aggregate("vs", start, step, lambda s: s["v"])

    return by.select(*keys, "n", at(F.expr("n div 4")).alias("p25"), at(F.expr("n div 2")).alias("p50"), at(F.expr("3 * n div 4")).alias("p75"))


def log_summary(log: DataFrame) -> DataFrame:
    """Rows, mean confidence and latency, rows of each tier and the cache's share."""
    tiers = [F.count_if(F.col("answered_by") == t).alias(f"n_{t}") for t in TIERS]
    n = F.count("*")
    return log.agg(n.alias("n"), F.avg("confidence").alias("confidence_mean"), F.avg("latency_ms").alias("latency_ms_mean"), *tiers, percent(F.count_if(F.col("answered_by") == "cache"), n).alias("cache_pct"))


def log_misses(log: DataFrame, below: float = 0.65) -> DataFrame:
    """Generated answers of low confidence: what is worth promoting."""
    return log.where((F.col("answered_by") == "generative") & (F.col("confidence") < below))


def log_by_hour(log: DataFrame) -> DataFrame:
    """Rows and mean latency of each hour and tier."""
    return log.groupBy(F.date_trunc("hour", "ts").alias("hour"), "answered_by").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("latency_ms_mean"))


def first_rows(log: DataFrame, n: int = 20) -> DataFrame:
    """The first rows in the order of the log."""
    return log.orderBy("ts", "query_id").limit(n)


def recent_rows(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("query_id")).limit(n)


def cache_summary(cache: DataFrame, words: Column) -> DataFrame:
    """Entries, mean answer words rounded down, distinct sources."""
    n = F.count("*")
    return cache.agg(n.alias("n"), F.floor(F.coalesce(F.sum(words), F.lit(0)) / F.greatest(n, F.lit(1))).alias("words_mean"), F.count_distinct("source").alias("n_sources"))


def cache_search(cache: DataFrame, term: str) -> DataFrame:
    """Entries with the term in question or answer, in any case."""
    t = term.lower()
    return cache.where(F.lower("question").contains(t) | F.lower("answer").contains(t))


def best_run(runs: DataFrame) -> DataFrame:
    """The run with the largest mean match; of equal ones the first by name."""
    return runs.orderBy(F.desc("match_mean"), "run").limit(1)


def history(runs: DataFrame) -> DataFrame:
    """A row for each run from nested reports: run, n and the overall metrics."""
    return runs.select("run", "n", "overall.rouge_l_mean", "overall.match_mean", "overall.p50", "overall.p95")


def judged_union(committed: DataFrame, file: DataFrame) -> DataFrame:
    """Relevance judgements (query_id, doc_ids): the file's in place of the committed ones of the same query."""
    f = file.select(F.col("query_id").alias("f_id"), F.col("doc_ids").alias("f_docs"))
    return committed.join(f, F.col("query_id") == F.col("f_id"), "full").select(F.coalesce("f_id", "query_id").alias("query_id"), F.coalesce("f_docs", "doc_ids").alias("doc_ids"))


def catalog_counts(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each corpus of a catalog with its chunks, a dash where there are none."""
    n = chunks.where(F.col("spec_id").isNotNull()).groupBy(F.col("spec_id").alias("c_id")).agg(F.count("*").alias("n"))
    return F.broadcast(catalog).join(n, F.col("spec_id") == F.col("c_id"), "left").select("spec_id", F.coalesce(F.col("n").cast("string"), F.lit("—")).alias("n_chunks"))
