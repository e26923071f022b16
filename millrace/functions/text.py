"""Column functions on text; each is a Column of built-in functions and stays in generated code where Spark allows.

``\\s`` and ``\\w`` differ between engines beyond ASCII, so classes are written out: white space is
ASCII white space, word characters are letters and digits of any script and the underscore.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[ \t\n\x0B\f\r]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once; within lambdas Spark evaluates an expression for each element."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def words(c: Column) -> Column:
    """Runs of characters between white space."""
    return F.filter(F.split(c, WHITE), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def normalize(c: Column) -> Column:
    """Lower case, ASCII punctuation (the underscore too) to spaces, single spaces, no outer space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\p{Punct}", " "), WHITE, " "))


def tokenize(c: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return words(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_ \t\n\x0B\f\r]", " "))


def truncate(c: Column, n: int, ellipsis: str = "…") -> Column:
    """The first n characters, with an ellipsis if something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ellipsis))).otherwise(c)


def span_fraction(c: Column, pattern: str) -> Column:
    """The share of characters that matches of the pattern cover, 0 for an empty text."""
    covered = F.aggregate(F.regexp_extract_all(c, F.lit(pattern), 0), F.lit(0), lambda n, x: n + F.length(x))
    return F.when(F.length(c) > 0, covered / F.length(c)).otherwise(F.lit(0.0))


def has_term(c: Column, terms: Sequence[str]) -> Column:
    """Whether one of the terms is among the lower-case tokens; digits and inner hyphens belong to tokens."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+(?:-[a-z0-9]+)*"), 0)
    return F.arrays_overlap(tokens, F.array(*map(F.lit, terms)))


def has_word(c: Column, terms: Sequence[str]) -> Column:
    """Whether one of the words occurs, in any case, between word boundaries."""
    return c.rlike(rf"(?i)\b({'|'.join(terms)})\b")


def lines(c: Column) -> Column:
    """The lines with something but white space, stripped."""
    return F.filter(F.transform(F.split(c, "\r\n|[\n\r\x0B\f]"), strip), lambda x: x != "")


def json_array(c: Column, schema: str) -> Column:
    """The array in a model's answer: fences dropped, from the first bracket to the last; null if it doesn't parse.

    An empty array is not null: it says that there is nothing, and null that the answer can't be read.
    """
    bare = F.regexp_replace(strip(c), r"^```(?:json)?|```$", "")
    found = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    return F.when(found != "", F.from_json(found, schema, {"mode": "PERMISSIVE"}))


def series_name(c: Column) -> Column:
    """``36.300`` to ``36_series``."""
    return F.concat(F.split_part(c, F.lit("."), F.lit(1)), F.lit("_series"))


def spec_of(source: Column, prefix: str = "3GPP TS ") -> Column:
    """What follows the prefix of a source; the source itself without it; ``(unknown)`` if there is none."""
    return F.when(source.startswith(prefix), F.regexp_replace(source, f"^{re.escape(prefix)}", "")).when(F.coalesce(source, F.lit("")) != "", source).otherwise(F.lit("(unknown)"))


def summary_line(tier: Column, confidence: Column, latency: Column) -> Column:
    return F.format_string("[%s] confidence=%.2f latency=%.3fs", tier, confidence, latency)


def entry(m: Column, key: str, default: object) -> Column:
    """A map's value, or the default where the map or the key is missing."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def merged(m: Column, more: Column) -> Column:
    """Both maps in one; of keys in both the second map's values. A null map counts as empty, two make null."""
    both = F.map_zip_with(m, more, lambda _, a, b: F.coalesce(b, a))
    return F.when(m.isNull(), more).when(more.isNull(), m).otherwise(both)
