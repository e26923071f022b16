"""The three tiers that answer, each a function from pending queries (query_id, query, context) to results.

Results have query_id, answer, confidence, details (JSON) and, from the retrieval tier, candidates: what it found but
did not trust, for the tiers after it. No tier raises; a null answer leaves the query to the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import CacheSettings, GenerativeSettings, RetrievalSettings, Settings
from millrace.functions.scores import confidence_of
from millrace.operators import cache, prompts
from millrace.operators.cascade import Tier
from millrace.operators.providers import Backend, generate
from millrace.operators.retrieval import BROADCAST_HITS, DenseIndex, Index, hybrid, lexical_score
from millrace.storage import table_cut

Answer = Callable[[DataFrame], DataFrame]
#: What the last tier says when no backend answers.
ALL_FAILED = "No backend was able to generate an answer."
#: Hits and their characters that a query takes to the next tier.
CANDIDATES, CANDIDATE_CHARS = 3, 800


def cache_tier(keys: DataFrame, settings: CacheSettings = CacheSettings(), fuzzy: bool = True) -> Answer:
    """Exact, normalised and fuzzy lookup of the stripped question among cache keys (question, answer, source, ordinal)."""

    def answer(pending: DataFrame) -> DataFrame:
        found = cache.lookup(pending.select("query_id", "query"), keys, settings.fuzzy_threshold, fuzzy)
        return found.select("query_id", "answer", "confidence", F.to_json(F.struct("match_type", "matched_key", "source")).alias("details"))

    return answer


def _best_hits(hits: DataFrame, docs: DataFrame, most: int, key: str, text: str, source: str) -> DataFrame:
    """Each query's best hits in order, with text and source: ``query_id, hits``."""
    bodies = docs.select(F.col(key).alias("b_id"), F.coalesce(F.col(text), F.lit("")).alias("answer"), F.coalesce(F.col(source), F.lit("")).alias("source"))
    few = hits.where(F.col("rank") < most)
    # Hits of all pending queries: broadcast only if counted to be few.
    rows = bodies.join(F.broadcast(few) if few.count() <= BROADCAST_HITS else few, F.col("b_id") == F.col("doc_id"))
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score", "source", "answer"))).alias("hits"))


def retrieval_tier(
    search: Callable[[DataFrame], DataFrame], docs: DataFrame, backends: Sequence[Backend], settings: RetrievalSettings = RetrievalSettings(), key: str = "doc_id", text: str = "text", source: str = "source"
) -> Answer:
    """Search, gate, and a synthesis from the best hits.

    ``search`` gives reranked hits (query_id, doc_id, score, rank). A query whose best score is below the least goes on
    before a backend is asked, and so does one for which all backends fail; either takes its candidates along. A query
    without a hit goes on without any.
    """

    def answer(pending: DataFrame) -> DataFrame:
        hits = table_cut(search(pending.select("query_id", "query")), "hits")
        rows = pending.select("query_id", "query").join(_best_hits(hits, docs, max(CANDIDATES, settings.synthesis_top_k), key, text, source), "query_id", "left")
        best = F.col("hits")[0]
        rows = rows.select("query_id", "query", "hits", best["doc_id"].alias("best_doc_id"), best["score"].alias("logit"), confidence_of(best["score"]).alias("confidence"))
        rows = table_cut(rows, "gated")
        passed = F.coalesce(F.col("logit") >= settings.min_rerank_score, F.lit(False))
        used = F.slice("hits", 1, settings.synthesis_top_k)
        asked = rows.where(passed).select("query_id", prompts.synthesis_prompt(F.col("query"), used, settings.synthesis_chunk_chars).alias("prompt"))
        made = asked.select(F.col("query_id").alias("m_id"), generate(F.col("prompt"), backends).alias("made"))
        rows = rows.join(made, F.col("query_id") == F.col("m_id"), "left")
        reason = F.when(F.col("hits").isNull(), "no_hits").when(~passed, "low_rerank_score").when(F.col("made.answer").isNull(), "synthesis_failed")
        cited = F.when(reason.isNull(), F.transform(used, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["source"].alias("source"))))
        details = F.struct(reason.alias("reason"), "best_doc_id", F.col("logit").alias("rerank_logit"), cited.alias("citations"), F.col("made.backend").alias("backend"), F.col("made.tokens_used").alias("tokens_used"), F.col("made.retry_count").alias("retry_count"))
        taken = F.transform(F.slice("hits", 1, CANDIDATES), lambda x: F.substring(x["answer"], 1, CANDIDATE_CHARS))
        return rows.select("query_id", F.when(reason.isNull(), F.col("made.answer")).alias("answer"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), taken.alias("candidates"), F.to_json(details).alias("details"))

    return answer


def generative_tier(backends: Sequence[Backend], settings: GenerativeSettings = GenerativeSettings()) -> Answer:
    """An answer from the query and the context that earlier tiers found; always one, with confidence 0 if all backends fail."""

    def answer(pending: DataFrame) -> DataFrame:
        context = F.coalesce("context", F.array().cast("array<string>"))
        made = pending.select("query_id", F.size(context).alias("n"), generate(prompts.context_prompt(F.col("query"), context, settings.context_chars), backends).alias("made"))
        ok = F.col("made.answer").isNotNull()
        details = F.struct("made.backend", "made.tokens_used", "made.retry_count", F.col("n").alias("retrieved_context_docs"), F.when(~ok, "all_backends_failed").alias("status"))
        return made.select("query_id", F.coalesce("made.answer", F.lit(ALL_FAILED)).alias("answer"), F.when(ok, settings.confidence).otherwise(0.0).alias("confidence"), F.to_json(details).alias("details"))

    return answer


def searcher(index: Index, vectors: DataFrame | DenseIndex, docs: DataFrame, encode: Callable[[Column], Column], settings: RetrievalSettings = RetrievalSettings(), score: Callable[[Column, Column], Column] = lexical_score) -> Callable[[DataFrame], DataFrame]:
    """The hybrid search over written indexes, for :func:`retrieval_tier`."""
    return lambda queries: hybrid(queries, index, vectors, docs, encode, settings, score)


def build(settings: Settings, keys: DataFrame | None = None, search: Callable[[DataFrame], DataFrame] | None = None, docs: DataFrame | None = None, backends: Sequence[Backend] = ()) -> list[Tier]:
    """The enabled tiers whose prerequisites are there, in order: the retrieval tier needs an index, the two that generate a backend."""
    tiers = []
    for name in settings.enabled_tiers:
        if name == "cache" and keys is not None:
            tiers.append(Tier("cache", cache_tier(keys, settings.cache), settings.cache.min_confidence))
        elif name == "retrieval" and search is not None and docs is not None and backends:
            tiers.append(Tier("retrieval", retrieval_tier(search, docs, backends, settings.retrieval), settings.retrieval.min_confidence))
        elif name == "generative" and backends:
            tiers.append(Tier("generative", generative_tier(backends, settings.generative), settings.generative.min_confidence))
    return tiers
