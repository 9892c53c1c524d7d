"""Sample arrays: one sorted array of draws for each line, scored without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_overrun(draws: Column, offset: Column) -> Column:
    """Mean of max(0, draw - offset) over an array, in the order of the array."""
    over = F.aggregate(draws, F.lit(0.0), lambda acc, d: acc + F.greatest(d.cast("double") - offset, F.lit(0.0)))
    return over / F.size(draws)


def nearest_rank(ordered: Column, p: float | Column) -> Column:
    """The ceil(p * n)-th value of an ascending array, the first at least; null for an empty array."""
    rank = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.size(ordered)).cast("int")) if not isinstance(p, Column) else F.greatest(F.lit(1), F.ceil(p * F.size(ordered)).cast("int"))
    return F.when(F.size(ordered) > 0, F.element_at(ordered, rank))


def exceedance(draws: Column, day: Column) -> Column:
    """Share of draws greater than ``day``."""
    return F.size(F.filter(draws, lambda d: d > day)) / F.size(draws)


def survival_grid(draws: Column, days: int | list[int]) -> Column:
    """Share of draws beyond each day: days 1 to ``days``, or the days listed."""
    grid = F.sequence(F.lit(1), F.lit(days)) if isinstance(days, int) else F.array(*map(F.lit, days))
    return F.transform(grid, lambda k: exceedance(draws, k))


def ascending(values: Column) -> Column:
    return values == F.array_sort(values)


def non_increasing(values: Column) -> Column:
    return F.forall(F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: a >= b), lambda ok: ok)


def within_unit(values: Column) -> Column:
    return F.forall(values, lambda v: (v >= 0) & (v <= 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2_normalized(values: Column) -> Column:
    """A vector over its length, the length held at 1e-12 or more."""
    return F.transform(values, lambda v: v.cast("double") / F.greatest(F.sqrt(dot(values, values)), F.lit(1e-12)))


def masked_mean(vectors: Column, mask: Column, width: int) -> Column:
    """Mean over the unmasked vectors of an array of vectors; the count is held at 1e-9 or more."""
    total = F.greatest(F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m.cast("double")), F.lit(1e-9))
    return F.transform(
        F.sequence(F.lit(1), F.lit(width)),
        lambda i: F.aggregate(F.zip_with(vectors, mask, lambda v, m: F.element_at(v, i).cast("double") * m.cast("double")), F.lit(0.0), lambda acc, x: acc + x) / total,
    )


def marks(ordered: Column, count: int = 50) -> Column:
    """``count`` equally likely marks of a sample: the nearest ranks at the middle of each of ``count`` equal shares."""
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: nearest_rank(ordered, (2 * i - 1) / (2.0 * count)))


def ordered_digest(pairs: Column) -> Column:
    """SHA-256 of the ids of (rank, id) structs, joined by newlines in rank order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(pairs), lambda p: p["id"]), "\n"), 256)
