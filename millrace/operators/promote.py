"""Promotion of good answers into the cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.edits import near_pairs
from millrace.functions.text import word_count
from millrace.operators.dedup import greedy
from millrace.storage import ship, table_cut

# The gates.
CONFIDENCE_LEAST, WORDS_LEAST, DISTANCE_MOST = 0.60, 50, 0.30
#: Blocks of questions, about; texts of one, at least and at most, and its characters; tasks for each core among which pairs of blocks are dealt.
BLOCKS, BLOCK_LEAST, BLOCK_MOST, BLOCK_CHARS, TASKS = 32, 64, 1024, 400_000, 16


def first_gates(confidence: Column, answer: Column) -> Column:
    """The first of the gates on a row alone that it fails, null if it passes both."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) < CONFIDENCE_LEAST, "confidence").when(word_count(F.coalesce(answer, F.lit(""))) < WORDS_LEAST, "length")


def _in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """``block, low, high, l``: ``rows`` (id, x, m) in arrays of near lengths m, of about ``size`` texts at most. The driver sees a count for each length."""
    places, block, held = [], 0, 0
    for r in rows.groupBy("m").agg(F.count("*").alias("n")).orderBy("m").collect():
        most = max(1, min(size, BLOCK_CHARS // r["m"]))
        if held and held + r["n"] > most:
            block, held = block + 1, 0
        parts = -(-r["n"] // most)
        places.append((r["m"], block, parts))
        block, held = (block + parts, 0) if parts > 1 else (block, held + r["n"])
    of = rows.sparkSession.createDataFrame(places, "p_m int, first int, parts int")
    placed = rows.join(F.broadcast(of), F.col("m") == F.col("p_m")).withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")))
    return table_cut(placed.groupBy("block").agg(F.min("m").alias("low"), F.max("m").alias("high"), F.collect_list(F.struct("id", "m", "x")).alias("l")), "blocks")


def near_questions(left: DataFrame, right: DataFrame, most: float = DISTANCE_MOST, ordered: bool = False) -> DataFrame:
    """``a, b`` of texts (id, q) whose edit distance is at most ``most`` of the longer one, a of ``left`` and b of ``right``; an empty b meets the least empty a only.

    Texts lie in blocks of near lengths, and every two blocks whose lengths allow it are compared in one step, by counts of characters and then by bits: with a
    third of a text edited no part of it is sure to be left, so the pairs that are tried grow with both sides. ``ordered``: both sides are the same texts with an id each, and only pairs with a < b are wanted.
    """
    spark = left.sparkSession
    ship(spark)
    kinds = [x.schema["id"].dataType.simpleString() for x in (left, right)]
    l, r = (table_cut(x.select("id", F.lower("q").alias("x"), F.length("q").alias("m")), "questions") for x in (left, right))
    # Empty texts are all alike: the first of the left side stands for them, one row.
    first = F.broadcast(l.where("m = 0").agg(F.min("id").alias("a")).where("a is not null"))
    empty = r.where("m = 0").select(F.col("id").alias("b")).crossJoin(first).select("a", "b")
    size = max(BLOCK_LEAST, min(BLOCK_MOST, -(-max(l.count(), r.count()) // BLOCKS)))
    one = _in_blocks(l.where("m > 0"), size)
    two = one if ordered else _in_blocks(r.where("m > 0"), size)
    one, two = (x.select(*[F.col(c).alias(f"{side}_{c}") for c in x.columns]) for side, x in (("a", one), ("b", two)))
    reach = (F.col("a_low") * (1 - most) <= F.col("b_high") + 1e-6) & (F.col("b_low") * (1 - most) <= F.col("a_high") + 1e-6)
    # A row for each block: its ends.
    met = table_cut(one.select("a_block", "a_low", "a_high").join(F.broadcast(two.select("b_block", "b_low", "b_high")), reach & (F.col("a_block") <= F.col("b_block") if ordered else F.lit(True))).select(F.col("a_block").alias("m_a"), F.col("b_block").alias("m_b")), "met")
    pairs = met.join(one, F.col("m_a") == F.col("a_block")).join(two, F.col("m_b") == F.col("b_block")).select("a_l", "b_l")
    pairs = pairs.repartition(max(1, min(met.count(), TASKS * spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (a, m, x), (b, n, y) = ([v.field(f) for f in ("id", "m", "x")] for v in (batch.column(0)[i].values, batch.column(1)[i].values))
                p, q = near_pairs(x.to_pylist(), y.to_pylist(), np.maximum.outer(m.to_numpy(), n.to_numpy()), most)
                yield pa.RecordBatch.from_arrays([a.take(pa.array(p)), b.take(pa.array(q))], names=["a", "b"])

    found = pairs.mapInArrow(run, f"a {kinds[0]}, b {kinds[1]}")
    if ordered:
        return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found.distinct().unionByName(empty)


def promote(candidates: DataFrame, keys: DataFrame, most: float = DISTANCE_MOST) -> DataFrame:
    """``candidates`` (ordinal, question, answer, confidence, answer_in_chunk) with ``gate``: confidence, length, duplicate, skipped, or null if promoted.

    A row that says that its answer is not in its chunk is skipped; a missing flag counts as true.
    A question near a live key, or near one promoted before it in the same batch, is a duplicate;
    only rows that pass the first gates can stand in the way of later ones.
    """
    skipped = ~F.coalesce("answer_in_chunk", F.lit(True))
    rows = candidates.withColumn("gate", F.when(skipped, "skipped").otherwise(first_gates(F.col("confidence"), F.col("answer"))))
    passing = rows.where("gate is null").select(F.col("ordinal").cast("long").alias("id"), F.col("question").alias("q"), F.lower("question").alias("k"), F.length("question").alias("k_m"))
    passing = table_cut(passing, "passing")
    # Equal questions have the same neighbours: the first of them is compared, and the others go whether it stays or goes.
    named = table_cut(passing.groupBy("k", "k_m").agg(F.min("id").alias("rep"), F.min("q").alias("q")), "named")
    members = passing.select("id", "k", "k_m").join(named.drop("q"), ["k", "k_m"]).select("id", "rep")
    asked = named.select(F.col("rep").alias("id"), "q")
    live = keys.select(F.xxhash64("question").alias("id"), F.col("question").alias("q")).distinct()
    blocked = near_questions(live, asked, most).select(F.col("b").alias("id")).distinct()
    blocked = table_cut(blocked, "blocked")
    free = asked.join(blocked, "id", "left_anti")
    gone = greedy(near_questions(free, free, most, ordered=True)).where("not kept").select("id").unionByName(blocked).select(F.col("id").alias("gone_id"))
    lost = members.join(gone, F.col("rep") == F.col("gone_id")).select("id").unionByName(members.where("rep <> id").select("id")).distinct().select(F.col("id").alias("lost_id"))
    out = rows.join(lost, F.col("ordinal") == F.col("lost_id"), "left")
    return out.withColumn("gate", F.when(F.col("lost_id").isNotNull(), "duplicate").otherwise(F.col("gate"))).drop("lost_id")


def report(promoted: DataFrame) -> DataFrame:
    """The counters of a promotion; skipped rows are not among the evaluated ones."""
    g = F.col("gate")
    return promoted.agg(
        F.count_if(g.isNull() | (g != "skipped")).alias("n_evaluated"), F.count_if(g.isNull()).alias("n_promoted"), F.count_if(g == "confidence").alias("n_confidence"),
        F.count_if(g == "length").alias("n_length"), F.count_if(g == "duplicate").alias("n_duplicate"),
    )


def report_json(promoted: DataFrame, source: str, at: str) -> DataFrame:
    """One row with a promotion's report as JSON: where the candidates came from, when, the counters, and each gate with the rows that it stopped."""
    counters = report(promoted)
    gates = promoted.where("gate is not null").groupBy("gate").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("gate", "n"))).alias("rejected"))  # a row for each gate
    whole = counters.crossJoin(F.broadcast(gates)).select(F.lit(source).alias("source"), F.lit(at).alias("promoted_at"), F.struct(*counters.columns).alias("counts"), "rejected")
    return whole.select(F.to_json(F.struct("*")).alias("value"))
