"""Two independent checks of question-answer pairs, and the gates over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import bind, has_term, has_word, span_fraction, strip, word_count

# Word lists, patterns and bounds of the checks.
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can",
    "to", "of", "in", "for", "on", "at", "by", "with", "from", "as", "or", "and", "but", "if", "this", "that", "it", "its", "not", "no", "so", "than", "then", "when", "which", "what",
    "how", "why", "where", "who",
)
DOMAIN_TERMS = (
    "enb", "ue", "mme", "rrc", "s1ap", "nas", "eps", "bearer", "handover", "pdcp", "rlc", "mac", "tau", "attach", "timer", "cause", "harq", "qci", "teid", "pdn", "sgw", "pgw",
    "measurement", "reconfiguration", "pcell", "scell", "pcc", "scc", "drb", "srb", "erab", "gtp", "x2", "s1", "uu", "rlf", "prach", "cqi", "pmi", "harq-ack", "utran",
)
METADATA_WORDS = ("section", "clause", "release", "version", "specification", "document", "annex")
CROSS_REFERENCE = r"(?i)(?:described|specified|defined|found)\s+in\s+(?:sub)?(?:clause|section)s?\s+\d+(?:\.\d+)*"
GROUNDING_LEAST, UTILITY_LEAST = 0.60, 0.60
CROSS_REFERENCE_MOST, WORDS_LEAST = 0.30, 15


def significant_words(c: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Lower-case runs of three letters or more that aren't stopwords, as often as they come."""
    stop = F.array(*map(F.lit, stopwords))
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), 0), lambda w: ~F.array_contains(stop, w))


def grounding(answer: Column, chunk: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """The share of the answer's significant words, each as often as it comes, that the chunk has; 0 without any."""
    share = lambda said, known: F.when(F.size(said) > 0, F.size(F.filter(said, lambda w: F.array_contains(known, w))) / F.size(said)).otherwise(F.lit(0.0))
    return bind(significant_words(answer, stopwords), lambda said: bind(F.array_distinct(significant_words(chunk, stopwords)), lambda known: share(said, known)))


def utility_reasons(question: Column, answer: Column, terms: Sequence[str] = DOMAIN_TERMS) -> Column:
    """What speaks against a pair, in order."""
    share, n = span_fraction(answer, CROSS_REFERENCE), word_count(answer)
    checks = [
        F.when(share > CROSS_REFERENCE_MOST, F.concat(F.lit("crossref_dominated ("), F.format_string("%.0f", share * 100), F.lit("% of answer)"))),
        F.when(~has_term(answer, terms), F.lit("no_domain_term_in_answer")),
        F.when(n < WORDS_LEAST, F.format_string("answer_too_short (%d words)", n)),
        F.when(has_word(question, METADATA_WORDS) & ~has_term(question, terms), F.lit("question_asks_about_document")),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def utility(question: Column, answer: Column, terms: Sequence[str] = DOMAIN_TERMS) -> Column:
    """1 without a reason against a pair, else 0.5 less 0.15 for each further one, to three digits."""
    n = F.size(utility_reasons(question, answer, terms))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(F.greatest(F.lit(0.0), 0.5 - 0.15 * (n - 1)), 3))


def usable_pairs(rows: DataFrame) -> DataFrame:
    """``rows`` (question, answer) stripped, without empty ones."""
    rows = rows.withColumn("question", strip(F.coalesce("question", F.lit("")))).withColumn("answer", strip(F.coalesce("answer", F.lit(""))))
    return rows.where("question <> '' and answer <> ''")


def kb_gate(in_chunk: Column, grounded: Column, useful: Column) -> Column:
    """The first gate that a candidate fails on its way to the knowledge base, null if it passes; a missing flag fails."""
    return (
        F.when(~F.coalesce(in_chunk, F.lit(False)), "not_in_chunk").when(F.coalesce(grounded, F.lit(0.0)) < GROUNDING_LEAST, "low_grounding").when(F.coalesce(useful, F.lit(0.0)) < UTILITY_LEAST, "low_utility")
    )


def agreement(rows: DataFrame) -> DataFrame:
    """Pass rates of both checks and of both together, and their correlation (null for fewer than two rows or without variance)."""
    g, u = F.col("grounding_score"), F.col("utility_score")
    varied = (F.count("*") >= 2) & (F.stddev_samp(g) > 0) & (F.stddev_samp(u) > 0)
    n = F.count("*")
    return rows.agg(
        n.alias("n"), (F.count_if(g >= GROUNDING_LEAST) / n).alias("grounding_rate"), (F.count_if(u >= UTILITY_LEAST) / n).alias("utility_rate"),
        (F.count_if((g >= GROUNDING_LEAST) & (u >= UTILITY_LEAST)) / n).alias("both_rate"), F.when(varied, F.corr(g, u)).alias("correlation"),
    )


def gate_report(rows: DataFrame, gate: str = "gate") -> DataFrame:
    """Rows by the gate that they failed ('kept' for none), and their share in whole per cent."""
    counts = rows.groupBy(F.coalesce(gate, F.lit("kept")).alias("gate")).agg(F.count("*").alias("n"))
    total = rows.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("gate", "n", F.round(100.0 * F.col("n") / F.col("total"), 0).alias("pct"))


def kept_by_spec(rows: DataFrame, gate: str = "gate") -> DataFrame:
    """Kept rows of each spec and their share of all kept ones."""
    kept = rows.where(F.col(gate).isNull())
    total = kept.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    return kept.groupBy("spec").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("spec", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


def run_counts(rows: DataFrame) -> DataFrame:
    """Distinct chunks, pairs and runs of an output; rows without a run count as one run together."""
    runs = F.count_distinct("run_started_at") + F.max(F.when(F.col("run_started_at").isNull(), 1).otherwise(0))
    return rows.agg(F.count_distinct("source_chunk_id").alias("n_chunks"), F.count("*").alias("n_pairs"), runs.alias("n_runs"))
