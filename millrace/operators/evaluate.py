"""Evaluation runs, candidate generation, judgements and text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import TIERS
from millrace.functions.text import json_array
from millrace.functions.udfs import rouge_l_udf, token_match_f1_udf
from millrace.operators import metrics
from millrace.operators.cascade import Tier, route
from millrace.operators.providers import Backend, generate
from millrace.operators.sampling import not_yet_done
from millrace.operators.validate import grounding, kb_gate, usable_pairs, utility, utility_reasons
from millrace.sources import ledger
from millrace.sources.sinks import write_lines
from millrace.storage import scratch_path, table_cut

PAIR = "array<struct<question: string, answer: string>>"
EXCERPT_CHARS = 2000


ITEM = "query_id string, query string, reference string, expected_tier string, tags array<string>"
JUDGEMENT = "query_id string, doc_ids array<string>"


def eval_items(spark: SparkSession, rows: Sequence[tuple] = ()) -> DataFrame:
    """An eval set from literal rows of ITEM; ids must differ and tiers be ones that answer."""
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("eval items must have different ids")
    if bad := {r[3] for r in rows} - set(TIERS[:-1]):
        raise ValueError(f"unknown tiers: {', '.join(sorted(bad))}")
    return spark.createDataFrame(list(rows), ITEM)


def by_tier(items: DataFrame, tier: str) -> DataFrame:
    return items.where(F.col("expected_tier") == tier)


def committed_judgements(spark: SparkSession) -> DataFrame:
    """The judgements that come with the engine: none, with their types."""
    return spark.createDataFrame([], JUDGEMENT)


def run(items: DataFrame, tiers: list[Tier]) -> DataFrame:
    """Route every eval item (query_id, query, reference, expected_tier) through the tiers and score the answers: :func:`facts` with backend."""
    routed = table_cut(route(items.select("query_id", "query"), tiers), "routed")
    backend = routed.select(F.col("query_id").alias("b_id"), F.get_json_object("details", "$.backend").alias("backend"))
    return facts(items, routed).join(backend, F.col("query_id") == F.col("b_id"), "left").drop("b_id")


def facts(items: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each eval item (query_id, reference, expected_tier) with its result (query_id, answer, answered_by, confidence).

    An item without a result counts as answered by no tier. Scores compare the answer with the reference.
    """
    r = results.select(F.col("query_id").alias("r_id"), "answer", "answered_by", "confidence")
    rows = items.join(r, F.col("query_id") == F.col("r_id"), "left").drop("r_id")
    rows = rows.withColumn("answer", F.coalesce("answer", F.lit(""))).withColumn("answered_by", F.coalesce("answered_by", F.lit("none"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return rows.select(
        "query_id", "answered_by", "expected_tier", "confidence", rouge_l_udf("answer", "reference").alias("rouge_l"), token_match_f1_udf("answer", "reference").alias("match_f1"),
        metrics.tier_match(F.col("answered_by"), F.col("expected_tier")).alias("tier_match"),
    )


def label_overlap(items: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The judged items, and the judgements that belong to no item."""
    ids = items.select(F.col("query_id").alias("i_id")).distinct()
    return judged.join(ids, F.col("query_id") == F.col("i_id"), "left_semi"), judged.join(ids, F.col("query_id") == F.col("i_id"), "left_anti")


def to_judge(hits: DataFrame, judged: DataFrame, again: bool = False) -> DataFrame:
    """Hits (query_id, doc_id) that nobody has judged yet; all of them with ``again``."""
    return hits if again else hits.join(judged.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")


def judge(judged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Judgements (query_id, doc_id, relevant) with later verdicts in place of earlier ones."""
    rows = judged.withColumn("j_order", F.lit(0)).unionByName(verdicts.withColumn("j_order", F.lit(1)))
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("relevant", "j_order").alias("relevant"))


def excerpt_prompt(chunk: Column) -> Column:
    return F.concat(F.lit("Write question and answer pairs about this excerpt as a JSON array of objects with question and answer:\n"), F.substring(chunk, 1, EXCERPT_CHARS))


def generate_pairs(chunks: DataFrame, backends: Sequence[Backend], calls_a_minute: int | None = None, tasks: int | None = None) -> DataFrame:
    """Checked candidates from chunks (chunk_id, source, chunk): a row for each pair that a model gives, with the tokens that its chunk took.

    An answer that can't be read is asked for again; an empty array says that there is nothing. Ids count every emitted pair of a chunk.
    """
    made = generate(excerpt_prompt(F.col("chunk")), backends, calls_a_minute, readable=True, tasks=tasks)
    asked = table_cut(chunks.select("chunk_id", "source", "chunk", made.alias("made")), "made")
    return check_pairs(asked)


CANDIDATE = "id string, source_chunk_id string, source string, question string, answer string, answer_in_chunk boolean, grounding_score double, utility_score double, reject_reasons array<string>, gate string, tokens_used int, run_started_at string"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`generate_in_batches` has committed to ``path``, each pair once."""
    return ledger.read_table(spark, path, "pairs", CANDIDATE).drop("batch", "attempt")


def asked_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``chunk_id`` of the chunks that have an answer in a committed batch, those that gave no pair too."""
    return ledger.read_table(spark, path, "asked", "chunk_id string").select("chunk_id")


def generate_in_batches(chunks: DataFrame, backends: Sequence[Backend], path: str, batches: int, run: str, done: DataFrame | None = None) -> int:
    """Generate candidates for the chunks (chunk_id, source, chunk) that aren't done and add them to ``path`` batch by batch; the number of batches written.

    Done are chunks of ``done`` (source_chunk_id) and those that a committed batch has an answer for. A batch counts once its record stands, after all its rows: one that fails
    half-way leaves nothing that is read, and its chunks are asked again. Chunks are dealt to batches once, so each batch reads its own. Ends
    before the next batch once a quota is exhausted.
    """
    spark = chunks.sparkSession
    chunks = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "source", "chunk")
    if done is not None:
        chunks = not_yet_done(chunks, done, "chunk_id", "source_chunk_id")
    chunks = not_yet_done(chunks, asked_chunks(spark, path), "chunk_id", "chunk_id")
    place = scratch_path(spark, "dealt")
    chunks.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(batches)).cast("int")).write.partitionBy("part").parquet(place)
    dealt = spark.read.schema("chunk_id string, source string, chunk string, part int").parquet(place)
    made = generate(excerpt_prompt(F.col("chunk")), backends, readable=True)
    for k in range(batches):
        asked = table_cut(dealt.where(F.col("part") == k).select("chunk_id", "source", "chunk", made.alias("made")), "made")

        def write(suffix: str, asked: DataFrame = asked) -> tuple[int, int]:
            answered = asked.where(F.col("made.answer").isNotNull()).select("chunk_id")
            pairs = check_pairs(asked).withColumn("run_started_at", F.lit(run))
            write_lines(answered, f"{path}/asked/{suffix}")
            write_lines(pairs, f"{path}/pairs/{suffix}")
            return pairs.count(), answered.count()

        ledger.write_batch(spark, path, write, run)
        if not asked.where(F.array_contains("made.failures", "quota")).isEmpty():
            return k + 1
    return batches


def check_pairs(asked: DataFrame) -> DataFrame:
    """The pairs in a model's answers (chunk_id, source, chunk, made), checked and gated."""
    rows = asked.select("chunk_id", "source", "chunk", "made.tokens_used", F.posexplode(json_array(F.col("made.answer"), PAIR)).alias("k", "pair")).select("chunk_id", "source", "chunk", "tokens_used", "k", "pair.question", "pair.answer")
    rows = usable_pairs(rows).withColumn("id", F.format_string("cand_%s_%02d", F.col("chunk_id").cast("string"), F.col("k")))
    g, u = grounding(F.col("answer"), F.col("chunk")), utility(F.col("question"), F.col("answer"))
    rows = rows.withColumn("grounding", g).withColumn("utility_score", u).withColumn("reject_reasons", utility_reasons(F.col("question"), F.col("answer")))
    # The bound is tested on the exact share; what is stored has three digits.
    rows = rows.withColumn("answer_in_chunk", F.col("grounding") >= 0.60).withColumn("gate", kb_gate(F.col("answer_in_chunk"), F.col("grounding"), F.col("utility_score")))
    return rows.select("id", F.col("chunk_id").alias("source_chunk_id"), "source", "question", "answer", "answer_in_chunk", F.round("grounding", 3).alias("grounding_score"), "utility_score", "reject_reasons", "gate", "tokens_used")


def render(report: DataFrame, title: str = "Evaluation") -> str:
    """A report table as text; for the few rows of an aggregate."""
    rows = [[("—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in report.collect()]
    width = [max(len(x) for x in col) for col in zip(report.columns, *rows, strict=True)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, width, strict=True)).rstrip()
    return "\n".join([title, "=" * len(title), line(report.columns), line(["-" * w for w in width]), *map(line, rows)])


def render_run(overall: DataFrame, tiers: DataFrame, backends: DataFrame, title: str = "Evaluation") -> str:
    """An evaluation as text: the rows of all tiers and of each (:func:`metrics.evaluation`), the shares of the tiers and of the backends, a part for each."""
    first = F.when(F.col("tier") == "overall", 0).otherwise(1)
    parts = [render(overall.orderBy(first, "tier"), title), render(tiers, "Answered by"), render(backends.orderBy(F.desc("n"), "backend"), "Backends")]
    return "\n\n".join(parts)


def render_promotion(counts: DataFrame) -> str:
    """The counters of :func:`promote.report`, one on a line."""
    row = counts.first().asDict()
    width = max(map(len, row))
    return "\n".join(["Promotion", "=========", *(f"{k.removeprefix('n_'):<{width}} {v:>8}" for k, v in row.items())])
