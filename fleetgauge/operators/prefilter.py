"""Rows whose key may be among those of another frame, found where they are scanned.

A join of a large table with a few winners shuffles the large table whole,
unless the winners are few enough to be broadcast.  Here a Bloom filter of
fixed size goes to the scan instead: the exchange then carries the winners'
rows and hardly any other.  Spark's own runtime filters need a predicate over
a scan on the creating side, which a ranking is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Words of 64 bits, 256 KB in all: of 100,000 keys in the filter, one other key in 500 passes.
# With more keys more pass, and the filter does not grow.
_WORDS = 1 << 15
# Bits a key sets in its word.
_BITS = 5


def _word(keys: str, words: int) -> str:
    return f"CAST(shiftrightunsigned(xxhash64({keys}), 32) & {words - 1} AS INT)"


def _mask(keys: str) -> str:
    bits = (f"shiftleft(1L, CAST(shiftrightunsigned(xxhash64({keys}), {6 * i}) & 63 AS INT))" for i in range(_BITS))
    return f"({' | '.join(bits)})"


def among(found: DataFrame, keys: Sequence[str], words: int = _WORDS) -> Column:
    """True for rows whose ``keys`` (columns of that name) ``found`` has, and for few others; never NULL.

    The filter is a scalar subquery, so nothing runs before an action.  It
    reads every column of ``found``: its plan is then the same as where
    ``found`` is used itself, and Spark computes it up to its last exchange
    once.  ``words`` is a power of two.
    """
    listed = ", ".join(f"`{k}`" for k in keys)
    marks = found.selectExpr(f"{_word(listed, words)} AS word", f"{_mask(listed)} | {unpruned(found.columns)} AS mask")
    none = found.sparkSession.range(words).selectExpr("CAST(id AS INT) AS word", "0L AS mask")
    filled = marks.union(none).groupBy("word").agg(F.expr("bit_or(mask) AS mask"))
    bits = filled.agg(F.expr("array_sort(collect_list(struct(word, mask))).mask AS bits")).scalar()
    mask = F.expr(_mask(listed))
    return F.get(bits, F.expr(_word(listed, words))).bitwiseAND(mask) == mask


def unpruned(columns: Sequence[str]) -> str:
    """SQL of zero, for which Spark reads all columns: plans that differ in columns alone would not share an exchange."""
    return f"(xxhash64({', '.join(f'`{c}`' for c in columns)}) & 0L)"


def filterable(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether equal keys have equal hashes: names that compare by a collation are hashed byte by byte."""
    return not any("collate" in df.schema[k].dataType.simpleString() for k in keys)


def may_be_among(df: DataFrame, found: DataFrame, keys: Sequence[str], words: int = _WORDS) -> DataFrame:
    """Rows of ``df`` that can match ``found`` on ``keys``: all that do, and few others; all rows if keys are collated."""
    if not (filterable(df, keys) and filterable(found, keys)):
        return df
    return df.where(among(found, keys, words))
