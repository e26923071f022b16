"""Corpus cleaning and quality filters over a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import lines, strip

# Thresholds, patterns and markers of the filters.
MIN_CHARS = 150
DOT_SHARE, DIGIT_SHARE, CONTENTS_SHARE, REFERENCE_SHARE = 0.15, 0.60, 0.40, 0.40
RUNNING_HEAD = r"3GPP TS \d+\.\d+"
SPEC_REFERENCE = r"3GPP TS \d\d\.\d\d\d"
BOILERPLATE = ("All rights reserved", "Organizational Partners", "Postal address", "Internet http://", "shall not be construed")


def clean_text(c: Column, running_head: str = RUNNING_HEAD) -> Column:
    """Without dot leaders, running heads, runs of blank lines and of blanks, in this order."""
    c = F.regexp_replace(c, r"(?m)[ \t\x0B\f\r]*\.{4,}[ \t\x0B\f\r]*\d+\s*$", "")
    c = F.regexp_replace(c, rf"(?m)^{running_head}.*$", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def is_dense(c: Column, min_chars: int = MIN_CHARS) -> Column:
    """Whether a text is prose: long enough, and neither dots, digits nor lines with page numbers prevail; all bounds are strict."""
    text = strip(c)
    solid = F.regexp_replace(text, " ", "")
    n = F.length(solid)
    dots = n - F.length(F.regexp_replace(solid, r"\.", ""))
    digits = n - F.length(F.regexp_replace(solid, r"[0-9]", ""))
    all_lines = lines(text)
    numbered = F.size(F.filter(all_lines, lambda x: x.rlike(r"[\p{L}\p{N}_][ \t]+\d{1,4}$")))
    return (
        (F.length(text) >= min_chars) & (n > 0) & (dots <= DOT_SHARE * n) & (digits <= DIGIT_SHARE * n) & (numbered <= CONTENTS_SHARE * F.size(all_lines))
    )


def is_references(c: Column, spec: str = SPEC_REFERENCE) -> Column:
    """Whether most lines are entries of a reference list."""
    all_lines = lines(c)
    hits = F.size(F.filter(all_lines, lambda x: x.rlike(r"^\[\d+\]") | x.rlike(spec)))
    return (F.size(all_lines) > 0) & (hits > REFERENCE_SHARE * F.size(all_lines))


def is_boilerplate(c: Column, markers: Sequence[str] = BOILERPLATE) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | c.contains(m)
    return hit


def heading_clause(c: Column) -> Column:
    """The top clause number of a numbered heading of two levels or more, else null."""
    text = strip(c)
    title = F.regexp_extract(text, r"(?s)^(\d+)((?:\.\d+)+)([A-Z][^\n]*)\n?$", 3)
    ok = F.length(text).between(4, 80) & ~F.substring(text, 1, 50).contains(":") & (title != "") & ~title.rlike(r"\d{1,4}$")
    return F.when(ok, F.regexp_extract(text, r"^(\d+)", 1).cast("int"))


def body_start(chunks: DataFrame) -> DataFrame:
    """``doc, start``: the first chunk with a heading of another clause than the document's first heading; 0 without one.

    ``chunks``: doc, idx, chunk. One window over the headings only, which are few in each document.
    """
    headings = chunks.select("doc", "idx", F.posexplode(F.split("chunk", "\n\n")).alias("pos", "paragraph")).withColumn("clause", heading_clause(F.col("paragraph"))).where("clause is not null")
    first = F.first("clause").over(Window.partitionBy("doc").orderBy("idx", "pos"))
    start = headings.withColumn("anchor", first).where("clause <> anchor").groupBy("doc").agg(F.min("idx").alias("found"))
    return chunks.select("doc").distinct().join(start, "doc", "left").select("doc", F.coalesce("found", F.lit(0)).alias("start"))


def drop_reason(text: Column, front: Column | None = None, min_chars: int = MIN_CHARS, markers: Sequence[str] = BOILERPLATE) -> Column:
    """The first filter that a chunk fails, null for a chunk that stays: density, front_matter, references, boilerplate."""
    out = F.when(~is_dense(text, min_chars), "density")
    if front is not None:
        out = out.when(front, "front_matter")
    return out.when(is_references(text), "references").when(is_boilerplate(text, markers), "boilerplate")


def drop_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows in, dropped by each filter, and kept, for each value of ``keys``; ``rows`` has ``reason``."""
    kinds = ("density", "front_matter", "references", "boilerplate")
    return rows.groupBy(*keys).agg(F.count("*").alias("n_in"), *[F.count_if(F.col("reason") == k).alias(f"n_{k}") for k in kinds], F.count_if(F.col("reason").isNull()).alias("n_kept"))
