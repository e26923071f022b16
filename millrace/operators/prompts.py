"""Prompts from retrieved text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT_CHARS = 2000
SNIPPET_GAP = "\n\n---\n"


def context_prompt(query: Column, snippets: Column, most: int = CONTEXT_CHARS) -> Column:
    """The query after the snippets that fit; whole ones only, up to the first that doesn't; the bare query without any."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def add(s: Column, x: Column) -> Column:
        n = s["n"] + F.length(x)
        fits = ~s["full"] & (n <= most)
        text = F.when(s["text"] == "", x).otherwise(F.concat(s["text"], F.lit(SNIPPET_GAP), x))
        return F.struct(F.when(fits, text).otherwise(s["text"]).alias("text"), F.when(fits, n).otherwise(s["n"]).alias("n"), (~fits).alias("full"))

    usable = F.filter(F.coalesce(snippets, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    context = F.aggregate(usable, start, add, lambda s: s["text"])
    return F.when(context == "", query).otherwise(F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), query))


def synthesis_prompt(query: Column, chunks: Column, chars: int | None = None) -> Column:
    """The query with each chunk (struct of source, doc_id, answer) under its source and id."""
    text = (lambda x: F.coalesce(x["answer"], F.lit(""))) if chars is None else (lambda x: F.substring(F.coalesce(x["answer"], F.lit("")), 1, chars))
    block = lambda x: F.concat(F.lit("["), F.coalesce(F.nullif(x["source"], F.lit("")), F.lit("unknown spec")), F.lit(", chunk "), F.coalesce(x["doc_id"].cast("string"), F.lit("")), F.lit("]:\n"), text(x))
    return F.concat(F.array_join(F.transform(chunks, block), "\n\n"), F.lit("\n\nQuestion: "), query)


#: What each tier tells its model before the question.
SYSTEM = {
    "synthesis": "Answer from the numbered excerpts alone. After each statement name the excerpt that it rests on. If they don't hold the answer, say so and stop.",
    "generative": "Answer the question briefly and plainly. Text under 'Context' may be wrong or beside the point: use what fits and leave the rest. Say so where you aren't sure.",
    "candidates": "Read the excerpt and write questions that it answers, each with its answer in the excerpt's own terms. Give a JSON array of objects with question and answer, and an empty array if there is nothing to ask.",
}


def with_system(prompt: Column, task: str) -> Column:
    """A prompt with its task's system text before it, for models that take one text."""
    return F.concat(F.lit(SYSTEM[task] + "\n\n"), prompt)
