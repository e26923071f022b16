"""The triage cascade: each tier gets what the ones before left, and every query ends with one row.

A tier is a function from pending queries (query_id, query, context) to results (query_id, answer,
confidence, and perhaps candidates and details). A null answer, or a confidence below the tier's least, leaves the query to
the next tier; an empty string is an answer. Each tier's results are written to the shared folder before they are split,
so no tier answers twice, even where an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import table_cut

#: Fixed value: what a query gets that no tier answers.
NO_ANSWER = "No tier was able to answer this query."


@dataclass(frozen=True)
class Tier:
    name: str
    answer: Callable[[DataFrame], DataFrame]
    min_confidence: float = 0.0


def delegates(answer: Column, confidence: Column, least: float) -> Column:
    """Whether a result leaves its query to the next tier."""
    return answer.isNull() | (F.coalesce(confidence, F.lit(0.0)) < least)


def route(queries: DataFrame, tiers: list[Tier]) -> DataFrame:
    """``query_id, query, answer, answered_by, confidence, tier_trace, details`` for every query.

    A result may have ``candidates`` (array of strings): they go to later tiers as ``context``, unless empty. ``details`` (a string) are
    those of the tier that answered, or of the last one.
    """
    if not tiers:
        raise ValueError("a cascade needs a tier")
    none = F.lit(None).cast("array<string>")
    pending = queries.select("query_id", "query", none.alias("context"), F.array().cast("array<string>").alias("tier_trace"), F.lit(None).cast("string").alias("details"))
    done: DataFrame | None = None
    for tier in tiers:
        result = tier.answer(pending.select("query_id", "query", "context"))
        given = lambda c, kind: F.col(c) if c in result.columns else F.lit(None).cast(kind)  # noqa: E731, B023
        result = result.select(F.col("query_id").alias("r_id"), "answer", F.col("confidence").cast("double").alias("confidence"), given("candidates", "array<string>").alias("candidates"), given("details", "string").alias("said"))
        rows = pending.join(result, F.col("query_id") == F.col("r_id"), "left").withColumn("tier_trace", F.array_append("tier_trace", F.lit(tier.name)))
        rows = table_cut(rows.withColumn("details", F.col("said")).withColumn("left", delegates(F.col("answer"), F.col("confidence"), tier.min_confidence)), f"tier-{tier.name}")
        out = rows.where(~F.col("left")).select("query_id", "query", "answer", F.lit(tier.name).alias("answered_by"), "confidence", "tier_trace", "details")
        done = out if done is None else done.unionByName(out)
        more = F.coalesce("candidates", F.array().cast("array<string>"))
        context = F.when(F.size(more) > 0, F.concat(F.coalesce("context", F.array().cast("array<string>")), more)).otherwise(F.col("context"))
        pending = rows.where("left").select("query_id", "query", context.alias("context"), "tier_trace", "details")
    unanswered = pending.select("query_id", "query", F.lit(NO_ANSWER).alias("answer"), F.lit("none").alias("answered_by"), F.lit(0.0).alias("confidence"), "tier_trace", "details")
    return done.unionByName(unanswered)
