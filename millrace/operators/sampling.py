"""Samples by hash order, apportionment, running ids and budgets.

A hash of the id and a seed puts rows in an order of their own; a prefix of it is a sample, and
smaller samples are parts of larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import table_cut


def hash_order(key: str, seed: int = 42) -> Column:
    """The place of a row in the order of a seed: the hexadecimal MD5 of id and seed, the same in every engine."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


#: Rows up to which a sample is taken as one ordered list; larger ones are cut by the first digits of the hash.
ONE_LIST = 100_000
DIGITS = 4
#: Rows of a range in which a running sum is made, about; rows of a table of groups up to which it is broadcast.
RANGE_ROWS, SMALL_TABLE = 1_000_000, 100_000


def nested_sample(rows: DataFrame, key: str, n: int, seed: int = 42, one_list: int = ONE_LIST) -> DataFrame:
    """n rows; those of a smaller n are among them.

    Of a large sample, whole ranges of the hash are taken by a filter, up to the range in which the n-th row is; only in that one are rows put in order.
    """
    order = hash_order(key, seed)
    if n <= one_list:
        return rows.orderBy(order, key).limit(n)
    head = F.substring(order, 1, DIGITS)
    taken = 0
    for r in sorted(rows.groupBy(head.alias("head")).agg(F.count("*").alias("n")).collect(), key=lambda r: (r["head"] is not None, r["head"])):  # at most 16 ** DIGITS rows
        if taken + r["n"] > n:
            return rows.where(head < r["head"]).unionByName(rows.where(head == r["head"]).orderBy(order, key).limit(n - taken))
        taken += r["n"]
    return rows


def fraction_sample(rows: DataFrame, key: str, rate: float, seed: int = 42) -> DataFrame:
    """int(count * rate) rows."""
    return nested_sample(rows, key, int(rows.count() * rate), seed)


def apportion(sizes: DataFrame, seats: int) -> DataFrame:
    """``stratum, n, k``: seats in proportion to n by largest remainders; ties to the stratum that comes first (by ``first``)."""
    total = sizes.agg(F.sum("n").alias("total"))
    rows = sizes.crossJoin(F.broadcast(total)).withColumn("base", F.expr(f"n * {seats} div total")).withColumn("rest", F.pmod(F.col("n") * seats, F.col("total")))
    # One row for each stratum: a window without keys over a table of groups.
    place = F.row_number().over(Window.orderBy(F.desc("rest"), "first"))
    given = F.sum("base").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("place", place).withColumn("left", seats - given).select("stratum", "n", (F.col("base") + (F.col("place") <= F.col("left")).cast("long")).alias("k"))


def stratified_sample(rows: DataFrame, key: str, stratum: str, n: int, seed: int = 42, one_list: int | None = None) -> DataFrame:
    """n rows with each stratum's share; all rows if there are no more than n.

    As in :func:`nested_sample`: each stratum's rows are counted by the first digits of the hash, whole ranges below the one with its last seat are taken by
    a filter, and only the rows of that range are put in order. A range of more than ``one_list`` rows is divided by further digits first.
    """
    one_list = ONE_LIST if one_list is None else one_list
    sizes = table_cut(rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), F.min(key).alias("first")), "strata")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if total <= n:
        return rows
    order = hash_order(key, seed)
    # Each stratum's range: the digits it begins with, the seats left in it, its rows.
    cuts = apportion(sizes, n).select(F.col("stratum").alias("q_stratum"), F.lit("").alias("q_head"), F.col("k").alias("q_seats"), F.col("n").alias("q_rows")).where("q_seats > 0")
    digits = 0
    while True:
        cuts = table_cut(cuts, "cuts")
        wide = cuts.where((F.col("q_rows") > one_list) & (F.col("q_seats") < F.col("q_rows")))
        if digits >= 32 or wide.isEmpty():
            break
        digits += DIGITS
        head = F.substring(order, 1, digits)
        # The digits of a null key are null and come first.
        counts = rows.select(F.col(stratum).alias("c_stratum"), head.alias("c_head")).join(_few(wide), F.col("c_stratum").eqNullSafe(F.col("q_stratum")) & F.coalesce(F.startswith("c_head", "q_head"), F.lit(True)))
        counts = counts.groupBy("q_stratum", "q_seats", "c_head").agg(F.count("*").alias("c"))
        so_far = F.sum("c").over(Window.partitionBy("q_stratum").orderBy("c_head"))  # at most 16 ** DIGITS rows for each stratum
        last = counts.withColumn("s", so_far).where((F.col("s") >= F.col("q_seats")) & (F.col("s") - F.col("c") < F.col("q_seats")))
        cuts = cuts.where((F.col("q_rows") <= one_list) | (F.col("q_seats") >= F.col("q_rows"))).unionByName(last.select("q_stratum", F.coalesce("c_head", F.lit("")).alias("q_head"), (F.col("q_seats") - F.col("s") + F.col("c")).alias("q_seats"), F.col("c").alias("q_rows")))
    names = rows.columns
    found = rows.withColumn("q_order", F.coalesce(order, F.lit(""))).join(_few(cuts), F.col(stratum).eqNullSafe(F.col("q_stratum")))
    own = F.substring(F.col("q_order"), F.lit(1), F.length("q_head"))
    whole = found.where((own < F.col("q_head")) | (own == F.col("q_head")) & (F.col("q_seats") >= F.col("q_rows")))
    last = found.where((own == F.col("q_head")) & (F.col("q_seats") < F.col("q_rows")))
    place = F.row_number().over(Window.partitionBy("q_stratum").orderBy("q_order", key))  # rows of one range
    return whole.select(*names).unionByName(last.withColumn("q_place", place).where("q_place <= q_seats").select(*names))


def _few(rows: DataFrame) -> DataFrame:
    """A written table of a row for each group, marked for broadcast if it has at most SMALL_TABLE rows."""
    return F.broadcast(rows) if rows.count() <= SMALL_TABLE else rows


def running_ids(rows: DataFrame, pattern: str, first: int, *order: str, within: str | None = None, name: str = "id") -> DataFrame:
    """Ids such as ``real_00000`` by the rows' order, over all rows or within a group.

    Over all rows, places are counted in ranges of the first order column and summed up over the
    ranges, so no task holds more than a range.
    """
    if within:
        place = F.row_number().over(Window.partitionBy(within).orderBy(*order)) - 1 + first
        return rows.withColumn(name, F.format_string(pattern, *([F.col(within)] if "%s" in pattern else []), place))
    lead = order[0]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(lead, [i / n for i in range(1, n)] or [0.5], 1000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    rows = rows.withColumn("r_range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(lead))) if cuts else F.lit(0))
    sums = rows.groupBy("r_range").agg(F.count("*").alias("n"))
    before = sums.select(F.col("r_range").alias("b_range"), (F.sum("n").over(Window.orderBy("r_range")) - F.col("n")).alias("b_before"))
    place = F.col("b_before") + F.row_number().over(Window.partitionBy("r_range").orderBy(*order)) - 1 + first
    return rows.join(F.broadcast(before), F.col("r_range") == F.col("b_range")).withColumn(name, F.format_string(pattern, place)).drop("r_range", "b_range", "b_before")


def _overrun(rows: DataFrame, used: str, budget: float, by: list[str], order: tuple[str, ...], sums: tuple[Column, Column] | None = None) -> DataFrame:
    """Rows with ``b_stop``: whether what is used before a row and its mean for one more exceed the budget; ``sums``: tokens and rows before the group."""
    w = Window.partitionBy(*by).orderBy(*order)
    tokens, count = sums or (F.lit(0), F.lit(0))
    before = tokens + F.coalesce(F.sum(used).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    i = count + F.row_number().over(w) - 1
    return rows.withColumn("b_place", i).withColumn("b_stop", F.when(i > 0, before + before / i > budget).otherwise(F.lit(False)))


def within_budget(rows: DataFrame, used: str, budget: float, *order: str, by: list[str] | None = None, range_rows: int | None = None) -> DataFrame:
    """The rows before the first one at which the tokens used so far and their mean for one more row exceed the budget.

    A budget of 0 or less is none. ``by``: groups with a budget each. Without groups, rows are dealt to ranges of the order; the ranges' sums give each what is used
    before it, every range finds its first such row, and the first of those ends the result: no task holds more than a range.
    """
    if budget <= 0:
        return rows
    if by:
        w = Window.partitionBy(*by)
        return _overrun(rows, used, budget, by, order).withColumn("b_stopped", F.max(F.col("b_stop").cast("int")).over(w.orderBy(*order))).where("b_stopped = 0").drop("b_place", "b_stop", "b_stopped")
    parts = max(1, -(-rows.count() // (RANGE_ROWS if range_rows is None else range_rows)))
    names = rows.columns
    ranged = table_cut(rows.repartitionByRange(parts, *order).withColumn("b_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("b_range").agg(F.sum(used).alias("s"), F.count("*").alias("n"))  # a row for each range
    w = Window.orderBy("b_range")
    before = table_cut(sums.select(F.col("b_range").alias("a_range"), (F.sum("s").over(w) - F.col("s")).alias("b_tokens"), (F.sum("n").over(w) - F.col("n")).alias("b_rows")), "sums")
    placed = ranged.join(_few(before), F.col("b_range") == F.col("a_range"))
    flagged = _overrun(placed, used, budget, ["b_range"], order, (F.coalesce("b_tokens", F.lit(0)), F.col("b_rows")))
    first = flagged.where("b_stop").agg(F.min("b_place")).first()[0]
    return ranged.select(*names) if first is None else flagged.where(F.col("b_place") < first).select(*names)


def not_yet_done(rows: DataFrame, done: DataFrame, key: str, done_key: str) -> DataFrame:
    """The rows whose key is not among the done ones; done rows without a key don't count."""
    return rows.join(done.where(F.col(done_key).isNotNull()).select(F.col(done_key).alias("d_key")).distinct(), F.col(key) == F.col("d_key"), "left_anti")
