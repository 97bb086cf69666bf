"""Text similarity: the Indel ratio from the longest common subsequence.

In Spark's own functions for single columns, and as Arrow functions, which hold a row of the table in the bits of one
number, for joins that test many pairs.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType, IntegerType


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of the table for each letter of a, folded over b."""
    other = letters(b)
    zero = F.transform(F.concat(F.array(F.lit("")), other), lambda _: F.lit(0))

    def row(previous: Column, letter: Column) -> Column:
        def cell(acc: Column, i: Column) -> Column:
            best = F.when(other[i - 1] == letter, previous[i - 1] + 1).otherwise(F.greatest(previous[i], F.element_at(acc, -1)))
            return F.concat(acc, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.size(other)), F.array(F.lit(0)), cell)

    table = F.when((a == "") | (b == ""), F.array(F.lit(0))).otherwise(F.aggregate(letters(a), zero, row))
    return F.element_at(table, -1)


def similarity(a: Column, b: Column) -> Column:
    """floor(200 x common / (len a + len b)); two empty texts are alike. Not the Levenshtein ratio."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100).otherwise(F.floor(F.lit(200) * common_length(a, b) / total)).cast("int")


def may_reach(a: Column, b: Column, least: int) -> Column:
    """The exact length bound: only such pairs can have a similarity of `least` or more."""
    return F.lit(200) * F.least(F.length(a), F.length(b)) >= F.lit(least) * (F.length(a) + F.length(b))


def partial_similarity(a: Column, b: Column) -> Column:
    """The best similarity of the shorter text with a window of its length in the longer one."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    starts = F.sequence(F.lit(1), F.greatest(F.length(long) - F.length(short) + 1, F.lit(1)))
    return F.array_max(F.transform(starts, lambda s: similarity(short, F.substr(long, s, F.length(short)))))


def text_match(a: Column, b: Column, least: int = 85, part: int = 90) -> Column:
    """Neither is empty, and one holds the other, or their similarity, or their partial one, is high enough."""
    near = F.when(F.contains(a, b) | F.contains(b, a), True).when(may_reach(a, b, least) & (similarity(a, b) >= least), True)
    return F.when((a == "") | (b == ""), False).otherwise(F.coalesce(near, (F.least(F.length(a), F.length(b)) >= 2) & (partial_similarity(a, b) >= part)))


@lru_cache(maxsize=4096)
def bits_of(text: str) -> dict[str, int]:
    """For each letter the places at which it stands, as bits."""
    out: dict[str, int] = {}
    for place, letter in enumerate(text):
        out[letter] = out.get(letter, 0) | 1 << place
    return out


def common_bits(bits: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence of a text, given by bits_of() and its size, with another: a zero bit stands
    for a step of the table's row, and one addition and one subtraction make the next row."""
    whole = row = (1 << size) - 1
    for letter in other:
        if held := bits.get(letter):
            hit = row & held
            row = (row + hit | row - hit) & whole
    return size - row.bit_count()


def ratio(a: str, b: str) -> int:
    total = len(a) + len(b)
    return 200 * common_bits(bits_of(a), len(a), b) // total if total else 100


def partial_ratio(a: str, b: str) -> int:
    """The best ratio of the shorter text with a window of its length in the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0 if long else 100
    bits = bits_of(short)
    return max(200 * common_bits(bits, len(short), long[i : i + len(short)]) // (2 * len(short)) for i in range(len(long) - len(short) + 1))


@F.pandas_udf(IntegerType())
def similarity_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    """B42 in Arrow batches; null if a text is null."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(IntegerType())
def partial_similarity_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    """B43 in Arrow batches; null if a text is null."""
    return pd.Series([None if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b)], dtype="Int32")


@lru_cache(maxsize=65_536)
def texts_match(a: str, b: str, least: int, part: int) -> bool:
    if not a or not b:
        return False
    short, total = min(len(a), len(b)), len(a) + len(b)
    if a in b or b in a or (200 * short >= least * total and ratio(a, b) >= least):
        return True
    return short >= 2 and partial_ratio(a, b) >= part


def text_match_arrow(a: Column, b: Column, least: int = 85, part: int = 90) -> Column:
    """B44 in Arrow batches; null if a text is null. Pairs that come again are looked up."""

    @F.pandas_udf(BooleanType())
    def match(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else texts_match(x, y, least, part) for x, y in zip(a, b)], dtype="boolean")

    return match(a, b)
