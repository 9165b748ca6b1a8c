"""Binning of a value by sorted edges, in plain column expressions.

All functions treat NaN like NULL: Spark orders NaN above every number, so an unguarded
comparison would put a missing value into the last bin.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT_EPS = 2.0**-23  # distance from 1.0 to the next 32-bit float
GUARD_FLOOR = 1e-6
_STRIDE = 16


def float_array(values: Sequence[float]) -> Column:
    """A constant array; folded to one literal by the optimizer, however long it is."""
    if not values:
        return F.array().cast("array<float>")
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<float>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once and written once in the plan.

    A column used many times inside one expression is otherwise repeated each time, and nested
    uses multiply.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_at_most(edges: Sequence[float] | Column, x: Column) -> Column:
    """Number of sorted ``edges`` that are ``<= x``; 0 for a missing ``x``.

    A driver-side list longer than two strides is searched in two steps (every 16th edge, then
    the 16 edges behind it), so 257 edges cost about 32 comparisons instead of 257.
    """
    value = F.when(~F.isnan(x), x.cast("float"))
    arr = edges if isinstance(edges, Column) else float_array(edges)
    if not isinstance(edges, Column) and len(edges) > 2 * _STRIDE:
        n = count_in_long(arr, float_array(edges[_STRIDE - 1 :: _STRIDE]), value)
    else:
        n = let(value, lambda v: F.size(F.filter(arr, lambda e: e <= v)))
    return F.coalesce(n, F.lit(0)).cast("int")


def every_stride(edges: Column) -> Column:
    """Every 16th of the sorted edges: the first step of :func:`count_in_long`."""
    return F.filter(edges, lambda e, i: F.pmod(i + 1, F.lit(_STRIDE)) == 0)


def count_in_long(edges: Column, coarse: Column, value: Column) -> Column:
    """Number of ``edges <= value`` in two steps, given every 16th edge as ``coarse``."""

    def fine(v: Column, c: Column) -> Column:
        return c * _STRIDE + F.size(F.filter(F.slice(edges, c * _STRIDE + 1, _STRIDE), lambda e: e <= v))

    return let(value, lambda v: let(F.size(F.filter(coarse, lambda e: e <= v)), lambda c: fine(v, c)))


def bin_by_edges(x: Column, edges: Sequence[float] | Column) -> Column:
    """Index of the half-open bin ``[edge[i], edge[i+1])``, clamped to the first and last bin."""
    last = (F.size(edges) if isinstance(edges, Column) else F.lit(len(edges))) - 2
    raw = count_at_most(edges, x) - 1
    return F.greatest(F.least(raw, last), F.lit(0)).cast("int")


def guard_bins(x: Column, edges: Sequence[float] | Column, bin_: Column) -> tuple[Column, Column]:
    """Lowest and highest bin that rounding of ``x`` could reach.

    A value within the tolerance of an inner edge also belongs to the bin across that edge.
    """
    arr = edges if isinstance(edges, Column) else float_array(edges)
    n = F.size(edges) if isinstance(edges, Column) else F.lit(len(edges))
    v = x.cast("float")
    tol = F.greatest(
        F.lit(GUARD_FLOOR).cast("float"),
        (F.lit(8.0 * FLOAT_EPS).cast("float") * F.greatest(F.abs(v), F.lit(1.0).cast("float"))),
    )
    near_low = ~F.isnan(v) & (F.abs(v - F.get(arr, bin_)) <= tol)
    near_high = ~F.isnan(v) & (F.abs(F.get(arr, bin_ + 1) - v) <= tol)
    lo = F.when((bin_ > 0) & near_low, bin_ - 1).otherwise(bin_)
    hi = F.when((bin_ + 1 < n - 1) & near_high, bin_ + 1).otherwise(bin_)
    return lo.cast("int"), hi.cast("int")


def rank_features(features: Column, cuts: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """Per feature the number of cut points ``<= x``, and a flag for missing values.

    With strictly increasing cuts ``x < cuts[k]`` holds exactly when ``rank <= k``.
    """
    ranks, missing = [], []
    for i, feature_cuts in enumerate(cuts):
        x = F.get(features, F.lit(i))
        ranks.append(count_at_most(list(feature_cuts), x))
        missing.append(x.isNull() | F.isnan(x))
    return F.array(*ranks), F.array(*missing)
