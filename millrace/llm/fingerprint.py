"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in SQL functions only.

A text's paragraphs (its lines, and the sentences of each) are hashed to codes: 44 bits of an MD5 digest
and 20 bits of check, a product of two parts of the digest, which sums of codes don't keep. The set of codes fills the cells of a sketch: each code is counted and
combined by exclusive or in one cell of each of three rows. Two sketches subtract cell by cell, and what
both have cancels; peeling cells that hold one valid code recovers the codes in which the texts
differ. If peeling gets stuck, the sketch was too small: the codes are dealt by their bits to as
many small sketches as the counts of the first let expect differences, and one of those that gets
stuck is tried at four times the width with other bits; what even that can't tell apart is compared as sets.

The likeness of two sketches is 1 - differing / (codes of both), 1 for two empty ones.

Next documents come from one shuffle: rows are dealt to ranges of doc_id cut at quantiles, and
the first row of each range is also dealt to the range before.

Defined results: a null text is empty, has no digest and is like another empty one; a null doc_id
sorts first; rows with equal doc_id follow each other in the order of their texts; a table of one
row is its own next; an empty table gives no rows; repeated paragraphs count once, but the
fingerprint also has the digest of the whole text; other columns do not matter.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 8  #: cells in each of the three rows of a sketch
ROUNDS = 6
#: Differences that each of the sketches of the second try should have to recover.
LOAD = 4
SMALL, LARGE = 8, 16  #: their width, and that of the third try
CHECK = (1 << 20) - 1
PARAGRAPH = r"(?<=[.!?])\\s+|\\n+"
_PRIME = 1_048_573  #: below 2**20
#: First bits of the cells in the three rows: of the fingerprint, of the second and the third try.
_FIRST, _SECOND, _THIRD = (34, 37, 40), (43, 46, 49), (52, 56, 60)
_DEAL = 20
#: Ranges of doc_id: for each partition of a shuffle at least, so many that a range has about RANGE_ROWS rows, and their largest number.
RANGES_PER_PARTITION, RANGE_ROWS, MOST_RANGES = 4, 20_000, 1 << 16
_names = count()


def _new(*names: str) -> tuple[str, ...]:
    k = next(_names)
    return tuple(f"{x}{k}" for x in names)


def _let(value: str, body) -> str:
    """``body`` of a name that stands for ``value``, which is evaluated once."""
    (name,) = _new("v")
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def _check(digest: str) -> str:
    """SQL: 20 bits of check for a digest of 44 bits, from the product of its two halves, which stays below 46 bits."""
    return f"({digest} % {_PRIME}) * ({digest} div {_PRIME} + 12345) % {_PRIME}"


def codes(text: str) -> str:
    """SQL: the distinct codes of a text's paragraphs."""
    digest = "cast(conv(substring(md5(cast(p AS binary)), 1, 11), 16, 10) AS bigint)"
    code = _let(digest, lambda d: f"shiftleft({d}, 20) | ({_check(d)})")
    return f"array_distinct(transform(filter(split({text}, '{PARAGRAPH}'), p -> p <> ''), p -> {code}))"


def _valid(code: str) -> str:
    return f"({code} <> 0 AND {_let(f'shiftrightunsigned({code}, 20)', _check)} = ({code} & {CHECK}))"


def sketch(keys: str) -> str:
    """SQL: the cells of a set of codes, with counts: the sketch that a fingerprint shows."""
    rows = []
    for bit in _FIRST:
        i, k, a = _new("i", "k", "a")
        mine = f"filter({keys}, {k} -> (shiftrightunsigned({k}, {bit}) & {WIDTH - 1}) = {i})"
        rows.append(f"transform(sequence(0, {WIDTH - 1}), {i} -> {_let(mine, lambda m, a=a, k=k: f"named_struct('n', size({m}), 'x', aggregate({m}, 0L, ({a}, {k}) -> {a} ^ {k}))")})")
    return f"concat({', '.join(rows)})"


def _cells(keys: str, bits: tuple[int, ...], width: int) -> str:
    """SQL: the cells of codes without counts; a code that comes twice cancels."""
    rows = []
    for bit in bits:
        i, k, a = _new("i", "k", "a")
        rows.append(f"transform(sequence(0, {width - 1}), {i} -> aggregate({keys}, 0L, ({a}, {k}) -> CASE WHEN (shiftrightunsigned({k}, {bit}) & {width - 1}) = {i} THEN {a} ^ {k} ELSE {a} END))")
    return f"concat({', '.join(rows)})"


def subtract(a: str, b: str) -> str:
    """SQL: the cells of sketch a without those of sketch b; counts are left out."""
    return f"zip_with({a}, {b}, (x, y) -> x.x ^ y.x)"


def peel(cells: str, bits: tuple[int, ...] = _FIRST, width: int = WIDTH) -> str:
    """SQL: the codes in which two sides differ, from their subtracted cells; null if peeling gets stuck."""
    s, r, c, i, a, k = _new("s", "r", "c", "i", "a", "k")

    def step(found: str) -> str:
        at = f"CASE WHEN {i} < {width} THEN {bits[0]} WHEN {i} < {2 * width} THEN {bits[1]} ELSE {bits[2]} END"
        less = f"aggregate({found}, {c}, ({a}, {k}) -> CASE WHEN (shiftrightunsigned({k}, {at}) & {width - 1}) = {i} % {width} THEN {a} ^ {k} ELSE {a} END)"
        return f"CASE WHEN size({found}) = 0 THEN {s} ELSE named_struct('cells', transform({s}.cells, ({c}, {i}) -> CASE WHEN {c} = 0 THEN 0L ELSE {less} END), 'out', concat({s}.out, {found})) END"

    pure = f"array_distinct(filter({s}.cells, {c} -> {_valid(c)}))"
    start = f"named_struct('cells', {cells}, 'out', cast(array() AS array<bigint>))"
    done = f"{s} -> CASE WHEN forall({s}.cells, {c} -> {c} = 0) THEN {s}.out END"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, ({s}, {r}) -> {_let(pure, step)}, {done})"


def _size(codes_or_null: str) -> str:
    """SQL: a size that is null for null, evaluated once."""
    return f"cast(array_size({codes_or_null}) AS bigint)"


def differing(a: str, b: str, sketch_a: str, sketch_b: str) -> str:
    """SQL: in how many codes two sets differ, from their sketches, or from larger ones where those are too small."""
    t, p, k, n, x, y, g, u = _new("t", "p", "k", "n", "x", "y", "g", "u")
    # Each difference adds about one to the squares of a row's counts, but for what their mean adds.
    more = f"cast(abs(size({a}) - size({b})) AS double)"
    squares = f"aggregate(zip_with({sketch_a}, {sketch_b}, ({x}, {y}) -> cast({x}.n - {y}.n AS double) * ({x}.n - {y}.n)), 0D, ({n}, {x}) -> {n} + {x}) / 3D - {more} * {more} / {WIDTH}D"
    bits = f"least(14, cast(ceil(log2(greatest(1D, {more} / {LOAD}D, ({squares}) / {LOAD}D))) AS int))"

    def dealt(keys: str, first: str, many: str, which: str) -> str:
        return f"filter({keys}, {k} -> (shiftrightunsigned({k}, {first}) & (shiftleft(1, {many}) - 1)) = {which})"

    def one(both: str, m: str) -> str:
        second = _size(peel(_cells(both, _SECOND, SMALL), _SECOND, SMALL))
        third = _size(peel(_cells(both, _THIRD, LARGE), _THIRD, LARGE))
        here = lambda keys: dealt(dealt(keys, str(_DEAL), f"cast({m} div 2 AS int)", g), f"cast({_DEAL} + {m} div 2 AS int)", f"cast({m} - {m} div 2 AS int)", p)
        sets = f"cast(size(array_except({here(a)}, {here(b)})) + size(array_except({here(b)}, {here(a)})) AS bigint)"
        return f"coalesce({second}, {third}, {sets})"

    def parts(group: str, m: str) -> str:
        rest = f"cast({m} - {m} div 2 AS int)"
        mine = dealt(group, f"cast({_DEAL} + {m} div 2 AS int)", rest, p)
        return f"aggregate(sequence(0, shiftleft(1, {rest}) - 1), {t}, ({u}, {p}) -> {u} + {_let(mine, lambda both: one(both, m))})"

    def groups(m: str) -> str:
        half = f"cast({m} div 2 AS int)"
        mine = dealt(f"concat({a}, {b})", str(_DEAL), half, g)
        return f"aggregate(sequence(0, shiftleft(1, {half}) - 1), 0L, ({t}, {g}) -> {_let(mine, lambda group: parts(group, m))})"

    return f"coalesce({_size(peel(subtract(sketch_a, sketch_b)))}, {_let(bits, groups)})"


def likeness(a: str, b: str, sketch_a: str, sketch_b: str) -> str:
    return f"CASE WHEN size({a}) + size({b}) = 0 THEN 1D ELSE 1D - {differing(a, b, sketch_a, sketch_b)} / (size({a}) + size({b})) END"


def as_text(text: str, keys: str, cells: str) -> str:
    """SQL: a sketch as text: digest of the whole, number of paragraphs, and the cells."""
    cell = "concat(cast(c.n AS string), '.', hex(c.x))"
    return f"concat('ibl2-', substring(md5(cast({text} AS binary)), 1, 16), '-', size({keys}), '-', array_join(transform({cells}, c -> CASE WHEN c.n = 0 THEN '' ELSE {cell} END), ','))"


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` and the sketch's parts for every row; a projection without a shuffle."""
    rows = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("codes", F.expr(codes("t"))).withColumn("cells", F.expr(sketch("codes")))
    return rows.select("doc_id", F.expr(as_text("t", "codes", "cells")).alias("fingerprint"), "codes", "cells")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text`` where next is the row after in ascending doc_id, and the first after the last."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("sid", F.coalesce("doc_id", F.lit(-(2**63))))
    wanted = min(MOST_RANGES, max(RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS)))
    cuts = rows.agg(F.percentile_approx("sid", [i / wanted for i in range(1, wanted)], max(10_000, 10 * wanted)).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    side = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + side] for i in range(0, len(cuts), side)] or [[2**63 - 1]]
    # A row's range: first among the groups of cuts, then within its group.
    heads, table = F.array(*[F.lit(g[0]) for g in groups]), F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    rows = rows.withColumn("g", F.greatest(F.lit(1), F.size(F.filter(heads, lambda x: x <= F.col("sid")))))
    rows = rows.withColumn("range", ((F.col("g") - 1) * (side + 1) + F.size(F.filter(F.element_at(table, F.col("g")), lambda x: x <= F.col("sid")))).cast("int")).drop("g")
    # At most MOST_RANGES + 1 rows: the least doc_id of each range, and the range before it.
    lows = sorted((r["range"], r["low"]) for r in rows.groupBy("range").agg(F.min("sid").alias("low")).collect())
    before = [(low, lows[i - 1][0], int(i == 0)) for i, (_, low) in enumerate(lows)]
    before = F.broadcast(spark.createDataFrame(before, "low long, prev int, wrap int"))
    own = F.struct(F.col("range"), F.lit(0).alias("wrap"), F.lit(True).alias("own"))
    copy = F.struct(F.col("prev").alias("range"), "wrap", F.lit(False).alias("own"))
    rows = rows.join(before, F.col("sid") == F.col("low"), "left")
    rows = rows.select("doc_id", "sid", "text", F.explode(F.when(F.col("prev").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("r"))
    w = Window.partitionBy("r.range").orderBy("r.wrap", "sid", "text")
    return rows.withColumn("next_text", F.lead("text").over(w)).where("r.own").select("doc_id", "text", "next_text")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's, and how alike they are.

    Edited: the last floor(n_chars / 4) code points replaced by the first as many of the next document.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 AS int)), substring(next_text, 1, cast(n_chars div 4 AS int)))"))
    rows = rows.select("doc_id", "n_chars", "text", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.expr(codes("text")).alias("a"), F.expr(codes("edited")).alias("e"), F.expr(codes("next_text")).alias("b"))
    for x in "aeb":
        rows = rows.withColumn(f"s{x}", F.expr(sketch(x)))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(as_text("text", "a", "sa")).alias("fingerprint"), F.expr(as_text("edited", "e", "se")).alias("edited_fingerprint"),
        F.expr(likeness("a", "e", "sa", "se")).alias("near_edited"), F.expr(likeness("a", "b", "sa", "sb")).alias("near_next"),
    )
