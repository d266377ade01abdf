"""Similarity of strings: the Indel ratio, as nested aggregates over characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence.

    One row of the usual table at a time: an outer fold over a's characters, an
    inner one over b's that carries (row so far, value to the left).
    """
    xs, ys = F.split(a, ""), F.split(b, "")
    start = F.transform(ys, lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        def cell(acc: Column, i: Column) -> Column:
            up, diagonal = F.get(prev, i), F.when(i > 0, F.get(prev, i - 1)).otherwise(0)
            left = F.when(i > 0, F.get(acc, i - 1)).otherwise(0)
            value = F.when(F.get(ys, i) == x, diagonal + 1).otherwise(F.greatest(up, left))
            return F.concat(acc, F.array(value))

        return F.aggregate(F.sequence(F.lit(0), F.size(prev) - 1), F.array().cast("array<int>"), cell)

    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.array_max(F.aggregate(xs, start, row)))


def ratio_bound(a: Column, b: Column) -> Column:
    """The ratio cannot exceed this."""
    n, m = F.length(a), F.length(b)
    return F.when(n + m == 0, 100.0).otherwise(200.0 * F.least(n, m) / (n + m))


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (len a + len b); 100 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * lcs_length(a, b) / total)
