"""Writers: tables and JSON lines, keyed objects, reports, CSV, logs and manifests."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str, append: bool = False, dry_run: bool = False) -> None:
    """JSON lines, in place of what was there or after it; nothing on a dry run."""
    if not dry_run:
        rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_table(rows: DataFrame, path: str, append: bool = False, bucket: str | None = None) -> None:
    writer = rows.write.mode("append" if append else "overwrite")
    (writer.partitionBy(bucket) if bucket else writer).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_promoted(promoted: DataFrame, path: str, now: datetime | None = None) -> None:
    """Promoted pairs with the time in UTC, after earlier ones; the curated cache isn't touched."""
    at = (now or datetime.now(timezone.utc)).isoformat()
    promoted.where("gate is null").select("question", "answer", "confidence", F.lit(at).alias("promoted_at")).write.mode("append").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Query-log rows: confidence to four digits and latency to one."""
    cols = ["ts", "query", "answered_by", F.round("confidence", 4).alias("confidence"), F.round("latency_ms", 1).alias("latency_ms"), "tiers_tried"]
    rows.select(*cols).write.mode("append").json(path)


#: Rows that a report or a file of judgements, one JSON object each, may hold.
MOST_ENTRIES = 100_000


def _bounded(rows: DataFrame, what: str) -> DataFrame:
    if rows.limit(MOST_ENTRIES + 1).count() > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} {what} for one JSON object: write them as lines")
    return rows


def report_json(overall: DataFrame, distributions: dict[str, DataFrame], per_query: DataFrame) -> DataFrame:
    """One row with a report as JSON text; of at most MOST_ENTRIES queries, more are an error."""
    per_query = _bounded(per_query, "queries")
    whole = overall.select(F.struct(*overall.columns).alias("overall"))
    for name, d in distributions.items():
        whole = whole.crossJoin(d.agg(F.sort_array(F.collect_list(F.struct(*d.columns))).alias(name)))
    whole = whole.crossJoin(per_query.agg(F.sort_array(F.collect_list(F.struct(*per_query.columns))).alias("per_query")))
    return whole.select(F.to_json(F.struct(*whole.columns)).alias("value"))


def write_judgements(rows: DataFrame, path: str) -> None:
    """Judgements (query_id, doc_ids) as one object with sorted keys; at most MOST_ENTRIES."""
    entries = _bounded(rows, "judgements").agg(F.sort_array(F.collect_list(F.struct("query_id", "doc_ids"))).alias("e"))
    entries.select(F.to_json(F.map_from_entries("e")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_manifest(spark: SparkSession, path: str, kb_path: str, n_docs: int, embedder: str, sha256: str) -> None:
    """What an index was built from, as one JSON object."""
    row = {"kb_path": kb_path, "kb_filename": kb_path.rsplit("/", 1)[-1], "n_docs": n_docs, "embedder_model": embedder, "built_at": datetime.now(timezone.utc).isoformat(), "kb_sha256": sha256}
    spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def manifest_matches(found: dict | None, filename: str, sha256: str | None, n_docs: int) -> tuple[bool, str]:
    """Whether an index belongs to a knowledge base, and by what: its name and then its hash, else the number of documents."""
    if found is None:
        return False, "missing"
    if found.get("kb_filename"):
        if found["kb_filename"] != filename:
            return False, "filename"
        if found.get("kb_sha256") and sha256:
            return found["kb_sha256"] == sha256, "hash"
        return True, "filename"
    return found.get("n_docs") == n_docs, "doc_count"
