"""The best rows for each query of a stated set, by scores of whole batches.

Queries come to the driver in blocks of bounded size and go to the tasks; each task scores its rows a batch at a time
and hands on the k best for each query. So rows are neither copied nor shuffled, whatever the scores; a
window over what is left makes the ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import ship

#: Digits to which scores are compared, so that the order of summation can't turn ties.
DIGITS = 9
#: Scores of a step, at most: queries times rows.
CELLS = 1 << 20


def ranked(rows: DataFrame, k: int, *ties: str, score: str = "score", key: str = "query_id") -> DataFrame:
    """The k best rows of each key with ``rank`` from 0; ties by the columns ``ties``."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round(score, DIGITS)), *ties)
    # The filter is on the row number itself, so that each task cuts its own rows before the shuffle.
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("rank", F.col("place") - 1).drop("place")


def blocks_of(queries: DataFrame, size: int, key: str = "query_id") -> Iterator[DataFrame]:
    """``queries`` in blocks of about ``size`` rows by a hash of the key; the rows are counted first."""
    n = -(-queries.count() // size)
    for b in range(n):
        yield queries if n == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == b)


def reaching(scores: np.ndarray, k: int, above: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and row numbers and rounded scores of at least the k best of each query; ``scores`` by query and row.

    Only scores larger than ``above`` count, and of a query's only those that are no less than its ``least`` when rounded.
    """
    n = scores.shape[1]
    on = scores >= np.maximum(least - 10.0**-DIGITS, np.nextafter(above, np.inf))[:, None]
    if n > k and np.count_nonzero(on) > 4 * k * len(scores):
        rounded = np.where(on, np.round(scores, DIGITS), -np.inf)
        on &= rounded >= np.partition(rounded, n - k, axis=1)[:, n - k, None]
    q, r = np.nonzero(on)
    value = np.round(scores[q, r], DIGITS)
    reach = value >= least[q]
    return q[reach], r[reach], value[reach]


def top_rows(rows: DataFrame, ids: pa.Array, score: Callable[[pa.RecordBatch], np.ndarray], k: int, id_type: str, query_type: str, above: float = -np.inf) -> DataFrame:
    """``query_id, doc_id, score`` of each task's k best rows for each query of one block, of those with a score larger than ``above``; ties by doc_id.

    ``rows`` starts with doc_id; ``score`` gives a batch's scores by query and row. ``ids``: the queries' ids in the order of the scores. A task holds a few times k
    rows for each query; most cells of a batch take one comparison with the k-th best score so far.
    """

    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, len(ids)))
        least = np.full(len(ids), -np.inf)
        held: list[tuple] = []

        def cut() -> tuple:
            docs = pa.concat_arrays([h[0] for h in held])
            q, value, exact = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            order = np.empty(len(docs), np.int64)
            order[pc.sort_indices(docs).to_numpy()] = np.arange(len(docs))
            at = np.lexsort((order, -value, q))
            place = np.arange(len(at)) - np.searchsorted(q[at], q[at])
            last = at[place == k - 1]
            least[q[last]] = value[last]
            at = at[place < k]
            return docs.take(pa.array(at)), q[at], value[at], exact[at]

        n = 0
        for b in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            s = score(b)
            q, r, value = reaching(s, k, above, least)
            if len(q):
                held.append((b.column(0).take(pa.array(r)), q, value, s[q, r]))
                n += len(q)
            if n > 2 * k * len(ids):
                held[:] = [cut()]
                n = len(held[0][1])
        if held:
            docs, q, _, exact = cut()
            for i in range(0, len(q), CELLS):
                part = slice(i, i + CELLS)
                yield pa.RecordBatch.from_pydict({"query_id": ids.take(pa.array(q[part])), "doc_id": docs[part], "score": pa.array(exact[part], pa.float64())})

    return rows.mapInArrow(run, f"query_id {query_type}, doc_id {id_type}, score double")


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
