"""Token files of a corpus: encode every text, write files in order of doc_id, read them back.

One shuffle by ranges of doc_id; each task streams its sorted rows and writes a file whenever it
has gathered FILE_TOKENS ids. A file counts once it is named in the manifest, which Spark commits;
what a lost or repeated task attempt has written is never read. Files and manifest are in the
shared folder, so they outlive executors. The folder is on a store that Arrow knows: a mounted one, HDFS, S3, Azure or Google storage.

Defined results: a null or empty text has the end id alone; a null doc_id sorts first; rows with
equal doc_id follow each other in the order of their texts; an empty table gives no file and no
row; a text longer than a file's usual size makes its own file; other columns do not matter.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import scratch_path, ship, table_cut

FILE_TOKENS = 1 << 22
END_ID = 2
#: Tasks that read files back, at most; a task reads one file after the other.
FILES_AT_ONCE = 20_000
#: Texts that are encoded at once.
_SLICE = 256


def known_uri(uri: str) -> str:
    """A folder's address as Arrow's file systems name it: Hadoop's names of the same stores are other ones."""
    for theirs, ours in (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfss://"), ("wasb://", "abfs://")):
        if uri.startswith(theirs):
            return ours + uri[len(theirs) :]
    return uri


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids with the end id, row by row, of batches with doc_id and text."""
    from millrace.llm.tokens import tokenizer

    tok = tokenizer(vocabulary)
    for b in batches:
        for i in range(0, b.num_rows, _SLICE):
            part = b.slice(i, _SLICE)
            ids, bounds = tok.encode(part.column(1))
            for k, doc_id in enumerate(part.column(0).to_pylist()):
                yield doc_id, np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))


def _writer(folder: str, vocabulary: str, end_id: int, file_tokens: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        from millrace.llm.ans import pack

        store, path = fs.FileSystem.from_uri(known_uri(folder))
        store.create_dir(path, recursive=True)
        task, number = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, size
            name = f"{task:06d}-{number:06d}-{uuid.uuid4().hex}.rans"
            data = pack(docs, np.array([len(p) for p in parts], np.int64), np.concatenate(parts))
            with store.open_output_stream(f"{path}/{name}.part") as f:
                f.write(data)
            store.move(f"{path}/{name}.part", f"{path}/{name}")
            row = pa.RecordBatch.from_pydict({"task": [task], "number": [number], "file": [f"{folder}/{name}"], "n_docs": [len(docs)], "n_tokens": [size], "n_bytes": [len(data)]})
            docs.clear()
            parts.clear()
            number, size = number + 1, 0
            return row

        for doc_id, ids in encoded(batches, vocabulary, end_id):
            docs.append(doc_id)
            parts.append(ids)
            size += len(ids)
            if size >= file_tokens:
                yield close()
        if docs:
            yield close()

    return write


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = END_ID, folder: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write ``doc_id, text`` as token files and return the manifest: task, number, file, n_docs, n_tokens, n_bytes and ``start``, the tokens before the file."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "task long, number long, file string, n_docs long, n_tokens long, n_bytes long"
    files = table_cut(rows.mapInArrow(_writer(folder, vocabulary, end_id, file_tokens), schema), "manifest")
    # Tokens before a task's files, from as many rows as there are tasks; then within each task.
    tasks = files.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    before = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("task").orderBy("number")) - F.col("n_tokens")
    return files.join(before, "task").select("task", "number", "file", "n_docs", "n_tokens", "n_bytes", (F.col("before") + own).alias("start"))


_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    from millrace.llm.ans import TokenFile

    for b in batches:
        for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            store, path = fs.FileSystem.from_uri(known_uri(uri))
            with store.open_input_stream(path) as f:
                data = TokenFile(f.read())
            docs, crcs = [], []
            for doc_id, ids in data.documents():
                docs.append(doc_id)
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            stop = np.cumsum(data.counts)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + stop - data.counts), pa.array(data.counts), pa.array(crcs, pa.int64())], schema=_ROWS)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32; every checksum is verified."""
    tasks = max(1, min(manifest.count(), FILES_AT_ONCE))
    files = manifest.select("file", "start").repartition(tasks)
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
