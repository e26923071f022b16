"""Batches of output that count once, whatever fails: each is written to a place of its own and then named in a record.

A batch's attempt writes its tables below ``<path>/<table>/batch=<n>/attempt=<id>``. Only then does its record
``<path>/_records/<n>.json`` come into being, whole, by a rename. Readers follow the records: what a failed attempt has left is
never read. One driver at a time writes to a path.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "batch long, attempt string, rows long, asked long, run string"
_NAME = "{:08d}.json"
#: Records up to which a reader names the batches in its filter; more are joined.
FILTERED = 1000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def records(spark: SparkSession, path: str) -> DataFrame:
    """The committed batches of a path: a row for each."""
    fs, p = _fs(spark, f"{path}/_records")
    if not fs.exists(p):
        return spark.createDataFrame([], RECORD)
    # Names that begin with a dot are records still being written.
    return spark.read.schema(RECORD).json(f"{path}/_records/[0-9]*.json")


def _next(spark: SparkSession, path: str) -> int:
    return (records(spark, path).agg(F.max("batch")).first()[0] or 0) + 1


def write_batch(spark: SparkSession, path: str, write: Callable[[str], tuple[int, int]], run: str) -> dict:
    """Write one batch: ``write`` puts its tables below a folder suffix and returns its rows and how many inputs it asked; the record that is committed."""
    batch, attempt = _next(spark, path), uuid.uuid4().hex
    rows, asked = write(f"batch={batch}/attempt={attempt}")
    record = {"batch": batch, "attempt": attempt, "rows": rows, "asked": asked, "run": run}
    fs, folder = _fs(spark, f"{path}/_records")
    fs.mkdirs(folder)
    _, final = _fs(spark, f"{path}/_records/{_NAME.format(batch)}")
    if fs.exists(final):
        raise RuntimeError(f"batch {batch} of {path} has a record already: another driver writes there")
    _, part = _fs(spark, f"{path}/_records/.{attempt}")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(record).encode() + b"\n"))
    out.close()
    if not fs.rename(part, final):
        raise RuntimeError(f"the record of batch {batch} could not be written")
    return record


def read_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """The rows of a table (JSON lines) from committed attempts alone, with ``batch`` and ``attempt``."""
    known = records(spark, path)
    found = known.select("batch", "attempt").limit(FILTERED + 1).collect()
    fs, p = _fs(spark, f"{path}/{table}")
    if not found or not fs.exists(p):
        return spark.createDataFrame([], f"{schema}, batch long, attempt string")
    rows = spark.read.schema(f"{schema}, batch long, attempt string").json(f"{path}/{table}")
    if len(found) <= FILTERED:
        return rows.where(F.col("attempt").isin([r["attempt"] for r in found]))
    return rows.join(known.select(F.col("attempt").alias("k_attempt")), F.col("attempt") == F.col("k_attempt"), "left_semi")
