"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Each source's documents, in a random order fixed by a hash, make blocks of equal numbers of documents. A source
with u of D units of the weight has its block b (from 0) released at slot floor(b * D / u) and due
at slot ceil((b + 1) * D / u); in each slot the released block with the earliest deadline goes
next (ties: the order of the targets). As the weights fill the slots, no deadline is missed, so up
to any slot each source has had its share to within less than one block. The schedule repeats
after D slots, so it is made once for D slots and rows find their slot by their rank.

Ranks within a source are counted in buckets of the hash, so a source with most of the rows is
spread like the others. Every row is kept: where a source runs out, its slots stay empty and the
others keep their order and their weights to each other.

Defined results: sources without a target, null ones too, share the weight ``rest`` in one group;
a null or empty text is a document like others; a row without doc_id is ordered by all its columns; repeated rows
take places next to each other; an empty table gives no rows; other columns are passed on, whatever their names, but
columns named like the four of :func:`mix` are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_DOCS = 16
#: Hexadecimal digits of the hash that name a bucket: 16 ** DIGITS buckets for each source, and more where these would hold more than BUCKET_ROWS rows.
DIGITS, BUCKET_ROWS = 3, 20_000
#: The columns of a place: the source's class, block, slot, and place in the block.
MIXED = ("mix_class", "mix_block", "mix_slot", "mix_place")
#: Rows of the table of bucket counts up to which it is broadcast (some 40 bytes each).
SMALL_TABLE = 200_000


def schedule(spark: SparkSession, units: list[int]) -> DataFrame:
    """One period of the schedule: ``slot, class, turn`` (which of the class's blocks of the period), sum(units) rows."""
    if any(u < 1 for u in units):
        raise ValueError("weights are positive whole numbers")
    d, n = sum(units), len(units)
    u = f"element_at(array({', '.join(map(str, units))}), i + 1)"
    release = f"(element_at(s.next, i + 1) * {d}) div {u}"
    due = f"cast(ceil((element_at(s.next, i + 1) + 1) * {d} / {u}) AS bigint)"
    best = f"array_min(filter(transform(sequence(0, {n - 1}), i -> CASE WHEN {release} <= t THEN named_struct('due', {due}, 'class', i) END), x -> x IS NOT NULL)).class"
    turn = "named_struct('next', transform(s.next, (x, i) -> CASE WHEN i = pick THEN x + 1 ELSE x END), 'picks', concat(s.picks, array(pick)))"
    start = f"named_struct('next', array_repeat(0L, {n}), 'picks', cast(array() AS array<int>))"
    made = f"aggregate(sequence(0L, {d - 1}L), {start}, (s, t) -> transform(array({best}), pick -> {turn})[0]).picks"
    slots = spark.range(1, numPartitions=1).select(F.posexplode(F.expr(made)).alias("slot", "class"))
    w = Window.partitionBy("class").orderBy("slot")
    return slots.select(F.col("slot").cast("long").alias("slot"), "class", (F.row_number().over(w) - 1).cast("long").alias("turn"))


def mix(docs: DataFrame, targets: dict[str, int], rest: int = 1, block_docs: int = BLOCK_DOCS, digits: int | None = None) -> DataFrame:
    """``docs`` with ``mix_class``, ``mix_block``, ``mix_slot`` and ``mix_place`` (in the block), not yet in order.

    ``targets``: units of weight by source; their number is a parameter and doesn't grow with the rows.
    """
    spark = docs.sparkSession
    names, units = list(targets), [*targets.values(), rest]
    d, n = sum(units), len(units)
    if digits is None:
        digits, most = DIGITS, docs.count()
        while most > BUCKET_ROWS * 16**digits:
            digits += 1
    # One row for each target: bounded by the parameter.
    table = F.broadcast(spark.createDataFrame([(x, i, units[i]) for i, x in enumerate(names)], "t_source string, t_class int, t_units int"))
    own = F.struct(*[c for c in docs.columns if c.lower() not in MIXED]).alias("row")  # whatever its names, they meet no others here
    rows = docs.select(own, F.col("source").cast("string").alias("source"), F.col("doc_id").alias("id"))
    rows = rows.join(table, F.col("source") == F.col("t_source"), "left").drop("t_source", "source")
    rows = rows.withColumn("t_class", F.coalesce("t_class", F.lit(n - 1))).withColumn("t_units", F.coalesce("t_units", F.lit(rest)))
    rows = rows.withColumn("t_hash", F.md5(F.coalesce(F.col("id").cast("string"), F.to_json("row")).cast("binary"))).withColumn("t_bucket", F.substring("t_hash", 1, digits))
    sums = rows.groupBy("t_class", "t_bucket").agg(F.count("*").alias("b_n"))
    by_class = Window.partitionBy("t_class").orderBy("t_bucket")
    before = sums.select(F.col("t_class").alias("b_class"), F.col("t_bucket").alias("b_bucket"), (F.sum("b_n").over(by_class) - F.col("b_n")).alias("b_before"))
    if n * 16**digits <= SMALL_TABLE:
        before = F.broadcast(before)
    rows = rows.join(before, (F.col("t_class") == F.col("b_class")) & (F.col("t_bucket") == F.col("b_bucket")))
    in_bucket = Window.partitionBy("t_class", "t_bucket").orderBy("t_hash", "id")
    rows = rows.withColumn("t_rank", F.col("b_before") + F.row_number().over(in_bucket) - 1)
    rows = rows.withColumn("mix_block", F.expr(f"t_rank div {block_docs}")).withColumn("mix_place", F.pmod("t_rank", F.lit(block_docs)).cast("int"))
    turns = schedule(spark, units).select(F.col("slot").alias("p_slot"), F.col("class").alias("p_class"), F.col("turn").alias("p_turn"))
    # sum(units) rows: bounded by the parameter.
    rows = rows.join(F.broadcast(turns), (F.col("t_class") == F.col("p_class")) & (F.pmod("mix_block", "t_units") == F.col("p_turn")))
    rows = rows.withColumn("mix_slot", F.expr(f"(mix_block div t_units) * {d}") + F.col("p_slot"))
    return rows.select("row.*", F.col("t_class").alias("mix_class"), "mix_block", "mix_slot", "mix_place")


def interleave(docs: DataFrame, targets: dict[str, int], rest: int = 1, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The rows of ``docs``, all columns and no others, in the mixed order: sorted by slot and place over all partitions."""
    kept = docs.select(F.struct(*docs.columns).alias("whole"), "source", "doc_id")
    return mix(kept, targets, rest, block_docs).orderBy("mix_slot", "mix_place").select("whole.*")
