"""Readers: JSON lines of three strictnesses, keyed JSON objects, reports, archives, pages and index tables."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from millrace.functions.text import series_name
from millrace.storage import table_cut

CORRUPT = "_corrupt_record"


def _schema(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def strict_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON object on each line; blank lines are skipped and a bad one raises."""
    return spark.read.schema(_schema(schema)).option("mode", "FAILFAST").json(path)


def tolerant_lines(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the bad lines; both empty if the path is missing."""
    s = _schema(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], s), spark.createDataFrame([], f"{CORRUPT} string")
    rows = spark.read.schema(StructType([*s.fields]).add(CORRUPT, StringType())).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    rows = table_cut(rows, "lines")  # what is bad is known only once all columns are read
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def dropping_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The good rows only; none if the path is missing."""
    s = _schema(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], s)
    return spark.read.schema(s).option("mode", "DROPMALFORMED").json(path)


def keyed_object(spark: SparkSession, path: str, value: str, required: bool = True) -> DataFrame:
    """``key, value`` of one JSON object; a missing file raises, or gives no rows if not ``required``."""
    if not required and not exists(spark, path):
        return spark.createDataFrame([], f"key string, value {value}")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def cache_file(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """``question, answer, source, added, ordinal`` of a cache file; the order of the file is the ordinal."""
    rows = keyed_object(spark, path, "struct<answer: string, source: string, added: date>", required)
    return rows.select(F.col("key").alias("question"), "value.answer", "value.source", "value.added").withColumn("ordinal", F.monotonically_increasing_id())


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, doc_ids`` of a file of judgements; no rows if it is missing."""
    return keyed_object(spark, path, "array<string>", required=False).select(F.col("key").alias("query_id"), F.col("value").alias("doc_ids"))


def reports(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """Reports in files of their own, newest name first; unreadable ones are left out."""
    rows = spark.read.schema(_schema(schema)).option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern).withColumn("file", F.input_file_name())
    return rows.orderBy(F.desc("file"))


def manifest(spark: SparkSession, path: str) -> dict | None:
    """An index manifest, None if it is missing or can't be read."""
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()["value"])
    except (AnalysisException, ValueError, TypeError):
        return None


def configured_rows(spark: SparkSession, path: str | None) -> int:
    """Rows of the knowledge base that the settings name (JSON lines, damaged ones not counted): of that file alone; 0 if none is named or it isn't there."""
    if not path:
        return 0
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return 0
    return spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'").count()


def newest_archives(files: DataFrame) -> DataFrame:
    """``spec, path`` with the lexicographically largest base name of each spec; ``files``: spec, path."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.groupBy("spec").agg(F.max_by("path", name).alias("path"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs with a blank line between them, then table rows with tabs between their cells; empty ones are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    parts = [text(p) for p in body.findall(f"{_W}p")]
    for row in body.iter(f"{_W}tr"):
        parts.append("\t".join(c for c in (text(cell) for cell in row.findall(f"{_W}tc")) if c))
    return "\n\n".join(p for p in parts if p)


def archive_document(data: bytes) -> bytes | None:
    """The first .docx of an archive, else the first .doc; None for a bad archive or neither."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            for end in (".docx", ".doc"):
                for n in names:
                    if n.lower().endswith(end):
                        return z.read(n)
    except zipfile.BadZipFile:
        return None
    return None


def archived_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of archives with a document each; null where there is none to read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for data in b["content"]:
                found = archive_document(data)
                try:
                    texts.append(docx_text(found) if found is not None else None)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    texts.append(None)
            yield pd.DataFrame({"path": b["path"], "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, text string")


def file_hashes(spark: SparkSession, path: str, most: int = 1_000_000) -> DataFrame:
    """``path, sha256`` of the first ``most`` bytes of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2(F.substring("content", 1, most), 256).alias("sha256"))


#: The corpora of the catalog. Ids, titles and archive files; what each covers is a note of our own.
CATALOG = (
    ("36.300", "E-UTRA and E-UTRAN Overall Description (Stage 2)", "Overview of the radio access network: its nodes, their interfaces and the split of functions between layers.", "36300-j20.zip"),
    ("36.331", "E-UTRA Radio Resource Control (RRC) Protocol Specification", "Control messages between terminal and base station, with their states, timers and fields.", "36331-j30.zip"),
    ("36.413", "E-UTRAN S1 Application Protocol (S1AP)", "Procedures and message formats on the link from base stations to the core's control plane.", "36413-j20.zip"),
    ("24.301", "Non-Access-Stratum (NAS) Protocol for EPS", "Registration, location and session procedures that terminals run with the core, and their reject causes.", "24301-k00.zip"),
    ("23.401", "GPRS Enhancements for E-UTRAN Access (EPS Architecture)", "Architecture of the packet core: its functions, reference points and flows for bearers and mobility.", "23401-k00.zip"),
)
ARCHIVE = "https://www.3gpp.org/ftp/Specs/archive"


def catalog(spark: SparkSession) -> DataFrame:
    """``spec_id, title, covers, version_zip, archive_url`` of every corpus; the address follows from the id."""
    rows = spark.createDataFrame(list(CATALOG), "spec_id string, title string, covers string, version_zip string")
    return rows.withColumn("archive_url", F.concat_ws("/", F.lit(ARCHIVE), series_name(F.col("spec_id")), "spec_id", F.lit("")))
