"""Promotion of answers as they come: keys that have been promoted are state, and end by timers.

A row that passes the gates on itself promotes its normalised question, unless that has been promoted within ``keep`` of event time. State is a
row for each promoted question; a timer clears it, so it doesn't grow with the log. Rows behind the watermark are dropped. What a batch gives is
written to a folder named by the batch, in place of what an earlier try has left: after a restart nothing is lost and nothing comes twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.text import normalize
from millrace.operators.promote import first_gates
from millrace.storage import ship

ANSWERED = "query_id string, ts timestamp, query string, answer string, confidence double"
PROMOTED = "key string, query_id string, ts timestamp, query string, answer string, confidence double"
#: Timers need a state store that can hold more than one value for each key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PromoteOnce(StatefulProcessor):
    """The first row of each key (by time, then query id), and none more until its timer ends."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.promoted = handle.getValueState("promoted", "query_id string, ts timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        first = None
        for part in rows:
            best = part.sort_values(["ts", "query_id"]).head(1)
            if first is None or (best["ts"].iloc[0], best["query_id"].iloc[0]) < (first["ts"].iloc[0], first["query_id"].iloc[0]):
                first = best
        if first is None or self.promoted.exists():
            return
        at = first["ts"].iloc[0]
        self.promoted.update((str(first["query_id"].iloc[0]), at.to_pydatetime()))
        self.handle.registerTimer(int(at.timestamp() * 1000) + self.keep_ms)
        yield first[["key", "query_id", "ts", "query", "answer", "confidence"]]

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.promoted.clear()
        yield from ()

    def close(self) -> None:
        pass


def promotions(log: DataFrame, keep: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """PROMOTED rows of a stream of ANSWERED rows."""
    spark = log.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    passing = log.withWatermark("ts", late).where(first_gates(F.col("confidence"), F.col("answer")).isNull() & F.col("query").isNotNull())
    keyed = passing.select(normalize(F.col("query")).alias("key"), "query_id", "ts", "query", "answer", "confidence")
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return keyed.groupBy("key").transformWithStateInPandas(PromoteOnce(keep_ms), PROMOTED, "append", "eventTime")


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``run_batches``: each batch in its own folder, in place of what an earlier try of it has left."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def promoted(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`append_once` has written, with ``batch``."""
    return spark.read.schema(f"{PROMOTED}, batch long").parquet(path)


def since(rows: DataFrame, at: datetime) -> DataFrame:
    """Promotions at a time or later: what a cache that was brought up to date then still lacks."""
    return rows.where(F.col("ts") >= F.lit(at))
