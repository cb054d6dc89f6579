"""Tail probabilities of rank tests as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this distance from the mean the density's series is summed, beyond it a continued fraction is.
NEAR = 3.0
SERIES_TERMS = 60
FRACTION_DEPTH = 80


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution; null where ``z`` is null or not a number."""
    distance = F.abs(z)
    density = F.exp(-distance * distance / 2.0) / math.sqrt(2.0 * math.pi)
    near, far = F.least(distance, F.lit(NEAR)), F.greatest(distance, F.lit(NEAR))

    def step(s: Column, k: Column) -> Column:
        # Each term of the odd series has the square of z over the next odd number more than the one before.
        term = s["term"] * near * near / (2.0 * k + 1.0)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    start = F.struct(near.alias("term"), near.alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), start, step, lambda s: s["sum"])
    fraction = F.aggregate(F.sequence(F.lit(FRACTION_DEPTH), F.lit(1), F.lit(-1)), far, lambda f, k: far + k / f)
    upper = F.when(distance < NEAR, 0.5 - density * series).otherwise(density / fraction)
    return F.when(~F.isnan(z), F.when(z < 0, 1.0 - upper).otherwise(upper))


def _places(last: Column) -> Column:
    return F.sequence(F.lit(0), last)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def rank_sum_tail(z: Column, u: Column, n_a: Column, n_b: Column, ties: Column) -> Column:
    """P(U >= u) by counting arrangements; ties have no such distribution and take the normal tail of ``z``.

    Row k of the table holds in how many ways k of the ranks so far sum to s more than the least sum they can have. A
    rank joins all rows at once, so a row works with n_a + n_b tables of the smaller size by n_a * n_b.
    """
    small, most, size = F.least(n_a, n_b).cast("int"), (n_a * n_b).cast("int"), (n_a + n_b).cast("int")
    start = F.transform(_places(small), lambda k: F.transform(_places(most), lambda s: F.when((k == 0) & (s == 0), 1.0).otherwise(0.0)))

    def join(ways: Column, rank: Column) -> Column:
        def row(k: Column) -> Column:
            def cell(s: Column) -> Column:
                moved = F.when(s >= rank - k, F.get(F.get(ways, k - 1), s - (rank - k))).otherwise(0.0)
                return F.get(F.get(ways, k), s) + moved

            return F.when((k == 0) | (k > rank), F.get(ways, k)).otherwise(F.transform(_places(most), cell))

        return F.transform(_places(small), row)

    def share(ways: Column) -> Column:
        last = F.get(ways, small)
        return _total(F.slice(last, u.cast("int") + 1, most + 1)) / _total(last)

    counted = F.aggregate(F.sequence(F.lit(1), size), start, join, share)
    return F.when((ties == 0) & (n_a * n_b > 0), counted).otherwise(normal_tail(z))


def signed_rank_p(z: Column, w: Column, n: Column, ties: Column, zeros: Column) -> Column:
    """Two-sided p by counting signs; ties and zeros have no such distribution and take ``z``."""
    most = (n * (n + 1) / 2).cast("int")
    start = F.transform(_places(most), lambda s: F.when(s == 0, 1.0).otherwise(0.0))

    def join(ways: Column, rank: Column) -> Column:
        return F.transform(ways, lambda x, s: x + F.when(s >= rank, F.get(ways, s - rank)).otherwise(0.0))

    def p(ways: Column) -> Column:
        return F.least(2.0 * _total(F.slice(ways, F.lit(1), w.cast("int") + 1)) / _total(ways), F.lit(1.0))

    counted = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, join, p)
    return F.when((ties == 0) & (zeros == 0) & (n > 0), counted).otherwise(2.0 * normal_tail(F.abs(z)))
