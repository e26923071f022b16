"""Exact order statistics of groups: selection by histograms, no group's values in one task.

Every wanted place of a group has a range of values in which it lies, at first the whole. In each round the rows within the range are counted by
equal steps of it, the step with the place becomes the range, shrunk to the values it holds, and so on until the range is one value or holds few rows;
those are put in order. Counts are combined before each shuffle, and a round's state is a row for each group and place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import table_cut

#: Steps into which a range is divided; rows of a range that are put in order at last; rows of state that are broadcast.
STEPS, FEW, SMALL_STATE = 1024, 4096, 100_000
_LARGEST = 1.7976931348623157e308


def _in_range(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that lie in a range of their group's places, a row for each place."""
    state = F.broadcast(state) if state.count() <= SMALL_STATE else state
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"s_{i}"))
    return rows.join(state, same & F.col("r_value").between(F.col("low"), F.col("high")))


def at_places(rows: DataFrame, keys: Sequence[str], value: str, places: DataFrame, few: int | None = None) -> DataFrame:
    """``s_0 .., place, found``: the values at the places, from 0 in ascending order, that ``places`` (s_0 .. for the keys, place) asks for.

    Nulls and values that aren't a number have no place. Infinite values count as the largest finite ones.
    """
    few = FEW if few is None else few
    held = rows.select(*keys, F.greatest(F.least(F.col(value).cast("double"), F.lit(_LARGEST)), F.lit(-_LARGEST)).alias("r_value")).where("r_value is not null and not isnan(r_value)")
    names = [f"s_{i}" for i in range(len(keys))]
    ends = held.groupBy(*[F.col(k).alias(f"e_{i}") for i, k in enumerate(keys)]).agg(F.min("r_value").alias("low"), F.max("r_value").alias("high"), F.count("*").alias("n"))
    same = F.lit(True)
    for i, name in enumerate(names):
        same = same & F.col(name).eqNullSafe(F.col(f"e_{i}"))
    state = table_cut(places.join(ends, same).select(*names, "place", F.lit(0).cast("long").alias("before"), "low", "high", "n"), "places")
    settled: list[DataFrame] = []
    while True:
        done = (F.col("low") == F.col("high")) | (F.col("n") <= few)
        settled.append(state.where(done))
        state = state.where(~done)
        if state.isEmpty():
            break
        # Halves, so that the width of a range is a number.
        step = F.least(F.floor((F.col("r_value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * STEPS), F.lit(STEPS - 1)).cast("int")
        counts = _in_range(held, state, keys).groupBy(*names, "place", "before", step.alias("step")).agg(F.count("*").alias("c"), F.min("r_value").alias("low"), F.max("r_value").alias("high"))
        so_far = F.sum("c").over(Window.partitionBy(*names, "place").orderBy("step"))  # at most STEPS rows for each place
        counts = counts.withColumn("upto", F.col("before") + so_far).where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place")))
        state = table_cut(counts.select(*names, "place", (F.col("upto") - F.col("c")).alias("before"), "low", "high", F.col("c").alias("n")), "places")
    ranges = settled[0]
    for x in settled[1:]:
        ranges = ranges.unionByName(x)
    one = ranges.where("low = high").select(*names, "place", F.col("low").alias("found"))
    left = _in_range(held, table_cut(ranges.where("low < high"), "ranges"), keys)
    order = F.row_number().over(Window.partitionBy(*names, "place").orderBy("r_value"))  # few rows for each place
    return one.unionByName(left.withColumn("r", F.col("before") + order - 1).where("r = place").select(*names, "place", F.col("r_value").alias("found")))


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], few: int | None = None) -> DataFrame:
    """``keys .., p0, p1 ..``: for each group the percentiles at ``shares`` with linear interpolation; groups without a value don't appear."""
    groups = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*[F.col(k).alias(f"s_{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n"))
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    wanted = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    names = [f"s_{i}" for i in range(len(keys))]
    groups = table_cut(groups, "groups")
    found = at_places(rows, keys, value, groups.select(*names, F.explode(wanted).alias("place")), few)
    by = found.groupBy(*[F.col(n).alias(f"g_{n}") for n in names]).agg(F.map_from_entries(F.collect_list(F.struct("place", "found"))).alias("m"))  # at most two places for each share
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"g_{n}"))

    def between(a):
        low, high = F.element_at("m", F.floor(a).cast("long")), F.element_at("m", F.ceil(a).cast("long"))
        return low + (high - low) * (a - F.floor(a))

    return groups.join(by, same).select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], *[between(a).alias(f"p{i}") for i, a in enumerate(at)])
