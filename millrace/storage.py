"""Tables between steps: written to the folder that the cluster shares and read back.

The folder is the one in ``spark.checkpoint.dir``. In local mode, as in tests, a temporary folder does where none is set;
on a cluster that is an error, for executors would write to disks of their own.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch, at most: a task holds few texts at once whatever their length.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_own: dict[str, str] = {}
_shipped: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small from here on."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is not None and not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once for each application, and keep the session's Arrow batches small."""
    small_batches(spark)
    root, app = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    # The archive is the driver's; Spark hands it to the executors.
    archive = Path(tempfile.mkdtemp(prefix="millrace-code-")) / "millrace_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "millrace").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables of this application."""
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/millrace/{app}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master or ""):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def table_cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here, and columns that nobody asks for aren't read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it has fewer partitions than the session has cores: small inputs of one file; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed (ms), 0 if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else 0


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; results that weren't written elsewhere go with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
