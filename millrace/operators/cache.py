"""The cache tier: exact, normalised and fuzzy lookup of questions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.profiles import Profiles, with_profile
from millrace.functions.scores import fuzzy_confidence
from millrace.functions.text import normalize, strip, words
from millrace.functions.token_sets import TokenSets
from millrace.functions.udfs import common_tokens_ratio_udf, token_set_ratio
from millrace.operators.topk import together
from millrace.storage import scratch_path, ship, spread, table_cut

#: Texts of a block of queries that goes to the tasks, and their characters.
BLOCK, BLOCK_CHARS = 8000, 4_000_000


def upsert(cache: DataFrame, added: DataFrame) -> DataFrame:
    """The cache (question, answer, source, ordinal) with later rows in place of earlier ones of the same question."""
    rows = cache.unionByName(added)
    return rows.groupBy("question").agg(F.max_by(F.struct("answer", "source", "ordinal"), "ordinal").alias("r")).select("question", "r.*")


def exact_lookup(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """``query_id, matched_key, answer, source`` where the stripped query is a key; case counts."""
    asked = queries.select("query_id", strip(F.col("query")).alias("k"))
    return asked.join(cache, F.col("k") == F.col("question")).select("query_id", F.col("question").alias("matched_key"), "answer", "source")


def normalized_index(cache: DataFrame) -> DataFrame:
    """One row for each normalised key; of keys that collide the last (by ordinal) stays."""
    rows = cache.withColumn("norm", normalize(F.col("question")))
    return rows.groupBy("norm").agg(F.max_by(F.struct("question", "answer", "source"), "ordinal").alias("r")).select("norm", "r.*")


def normalized_lookup(queries: DataFrame, cache: DataFrame) -> DataFrame:
    asked = queries.select("query_id", normalize(F.col("query")).alias("k"))
    return asked.join(normalized_index(cache), F.col("k") == F.col("norm")).select("query_id", F.col("question").alias("matched_key"), "answer", "source")


@dataclass(frozen=True)
class KeyIndex:
    """A written index of cache keys: ``keys`` (norm, question, answer, source, chars, profile: ordered by chars) and ``tokens`` (norm, token, whole)."""

    keys: DataFrame
    tokens: DataFrame


def key_index(cache: DataFrame, path: str | None = None) -> KeyIndex:
    """Normalise and profile every key once and write the index to ``path`` (a fresh place in the shared folder if there is none).

    Keys lie in files by length, so that a search reads those of lengths that can be near.
    """
    spark = cache.sparkSession
    path = path or scratch_path(spark, "keys")
    rows = with_profile(normalized_index(cache), "norm")
    rows.repartitionByRange("chars", "norm").sortWithinPartitions("chars").write.mode("overwrite").parquet(f"{path}/keys")
    _token_rows(spark.read.parquet(f"{path}/keys"), "norm").write.mode("overwrite").parquet(f"{path}/tokens")
    return load_key_index(spark, path)


def load_key_index(spark: SparkSession, path: str) -> KeyIndex:
    """An index that :func:`key_index` has written."""
    return KeyIndex(spark.read.parquet(f"{path}/keys"), spark.read.parquet(f"{path}/tokens"))


def _token_rows(rows: DataFrame, key: str) -> DataFrame:
    """``key, token, whole``: the distinct tokens of a normalised text, and the length of all of them with a space between."""
    tokens = F.array_distinct(words(F.col(key)))
    return rows.select(key, F.explode(tokens).alias("token"), (F.aggregate(tokens, F.lit(0), lambda n, x: n + F.length(x) + 1) - 1).alias("whole"))


def _rare_first(rows: DataFrame, key: str, df: DataFrame, share: float) -> DataFrame:
    """Of each text the rarest tokens, by ``df``, that make up more than ``share`` of its length."""
    rows = rows.join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    before = F.sum(F.length("token") + 1).over(Window.partitionBy(key).orderBy("df", "token")) - F.length("token") - 1
    return rows.withColumn("before", before).where(F.col("before") <= share * (F.col("whole") + 1)).select(key, "token")


def _token_candidates(q: DataFrame, k: DataFrame, t: float) -> DataFrame:
    """Pairs (q, norm) that may reach ``t`` because common tokens make up nearly all of one side; ``q`` and ``k``: rows of tokens.

    The common tokens against a side of length n reach t only if what the side has beyond them is at most 2 (1 - t) / (2 - t) of n:
    so one of its rarest tokens that make up more is common.
    """
    share = 2 * (1 - t) / (2 - t)
    df = k.groupBy("token").agg(F.count("*").alias("df"))
    return _rare_first(q, "q", df, share).join(k.select("norm", "token"), "token").select("q", "norm").unionByName(_rare_first(k, "norm", df, share).join(q.select("q", "token"), "token").select("q", "norm")).distinct()


def _length_blocks(texts: DataFrame) -> Iterator[DataFrame]:
    """``texts`` (q, chars) in blocks of near lengths, of about BLOCK rows and BLOCK_CHARS characters at most.

    The driver sees a count for each length. A length with more rows than a block holds is dealt out by a hash.
    """
    low, rows = None, 0
    counts = [(r["chars"], r["n"]) for r in texts.groupBy("chars").agg(F.count("*").alias("n")).orderBy("chars").collect()]
    most = lambda chars: max(1, min(BLOCK, BLOCK_CHARS // max(1, chars)))
    for i, (chars, n) in enumerate(counts):
        low, rows = chars if low is None else low, rows + n
        if i + 1 == len(counts) or rows + counts[i + 1][1] > most(counts[i + 1][0]):
            block = texts.where(F.col("chars").between(low, chars))
            parts = -(-rows // most(chars))
            for p in range(parts):
                yield block if parts == 1 else block.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == p)
            low, rows = None, 0


def _near_keys(texts: DataFrame, keys: DataFrame, threshold: float) -> DataFrame | None:
    """``q, norm, score`` of the pairs that reach the threshold by the edit distance of their token sets.

    A pair's edit distance is no less than the difference of its counts of characters, and a third of that of its counts of neighbouring
    characters, for token sets in whatever order. So a block of queries goes to the keys of near lengths, and only pairs whose counts
    allow the threshold are aligned, many at once (:class:`TokenSets`); those that may reach it are scored.
    """
    t = threshold / 100
    ship(texts.sparkSession)
    parts = []
    for block in _length_blocks(texts):
        found = [r["q"] for r in block.select("q").collect()]  # at most about BLOCK texts of BLOCK_CHARS characters in all
        if not found:
            continue
        profiled = Profiles.of(found)
        low, high = profiled.chars[0] * t / (2 - t), profiled.chars[-1] * (2 - t) / t if t > 0 else float("inf")
        near = spread(keys.where(F.col("chars").between(int(low), int(min(high, 2**31 - 2)) + 1)).select("norm", "profile"))

        def run(batches: Iterator[pa.RecordBatch], profiled: Profiles = profiled) -> Iterator[pa.RecordBatch]:
            texts, sets = profiled.texts, TokenSets(profiled.texts, threshold)
            for b in batches:
                names = b.column(0).to_pylist()
                near = (p for k, raw in enumerate(b.column(1)) for p in sets.add(k, names[k], np.array(profiled.near(names[k], raw.as_py(), t), np.int64)))
                out = [(texts[i], names[k], s) for i, k in chain(near, sets.rest()) if (s := token_set_ratio(texts[i], names[k], threshold)) >= threshold]
                q, n, s = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.string()), "norm": pa.array(n, pa.string()), "score": pa.array(s, pa.float64())})

        parts.append(near.mapInArrow(run, "q string, norm string, score double"))
    return together(parts) if parts else None


def fuzzy_lookup(queries: DataFrame, cache: DataFrame | KeyIndex, threshold: float = 90.0) -> DataFrame:
    """Each query's best key by token-set similarity of at least ``threshold``, with its score and confidence; ties by the key.

    Exact: the pairs that are scored hold all that can reach the threshold, by common tokens or by near counts of characters. Each way scores what it seeks; only
    the second aligns. Queries with a full score by common tokens need no further search.
    """
    asked = table_cut(queries.select("query_id", normalize(F.col("query")).alias("q")), "asked")
    index = cache if isinstance(cache, KeyIndex) else key_index(cache)
    texts = table_cut(with_profile(asked.select("q").distinct(), "q").drop("profile"), "texts")
    pairs = _token_candidates(_token_rows(texts, "q"), index.tokens, threshold / 100)
    pairs = table_cut(pairs.withColumn("score", common_tokens_ratio_udf("q", "norm")).where(F.col("score") >= threshold), "scored")
    rest = texts.join(pairs.where("score >= 100").select("q").distinct(), "q", "left_anti").where("chars > 0")
    near = _near_keys(rest, index.keys, threshold)
    if near is not None:
        pairs = pairs.unionByName(near)  # of a pair that comes by both ways the larger score counts
    # The largest score and then the least key, by partial aggregation.
    won = pairs.join(index.keys.select("norm", "question", "answer", "source"), "norm").groupBy("q").agg(F.min_by(F.struct("question", "answer", "source", "score"), F.struct(-F.round("score", 9), F.col("question"))).alias("k"))
    return asked.join(won, "q").select("query_id", F.col("k.question").alias("matched_key"), "k.answer", "k.source", "k.score", fuzzy_confidence(F.col("k.score"), threshold).alias("confidence"))


def lookup(queries: DataFrame, cache: DataFrame, threshold: float = 90.0, fuzzy: bool = True) -> DataFrame:
    """The tier's result for each query: match_type, matched_key, answer, source, confidence; nulls and 0 for a miss.

    Each step looks only at the queries that the one before left.
    """
    exact = exact_lookup(queries, cache).select("query_id", F.lit("exact").alias("match_type"), "matched_key", "answer", "source", F.lit(1.0).alias("confidence"))
    rest = queries.join(exact.select("query_id"), "query_id", "left_anti")
    norm = normalized_lookup(rest, cache).select("query_id", F.lit("normalized").alias("match_type"), "matched_key", "answer", "source", F.lit(0.95).alias("confidence"))
    hits = exact.unionByName(norm)
    if fuzzy:
        rest = rest.join(norm.select("query_id"), "query_id", "left_anti")
        hits = hits.unionByName(fuzzy_lookup(rest, cache, threshold).select("query_id", F.lit("fuzzy").alias("match_type"), "matched_key", "answer", "source", "confidence"))
    return queries.select("query_id").join(hits, "query_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
