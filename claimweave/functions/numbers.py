"""Money, statistics and geometry expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENTS = "decimal(18,2)"


def cents(x: Column) -> Column:
    return x.cast(CENTS)


def money_tolerance(a: Column, b: Column) -> Column:
    """A cent, or a hundredth of a percent of the larger amount."""
    largest = F.greatest(F.abs(a), F.abs(b), F.lit(1).cast(CENTS))
    return F.greatest(F.lit("0.01").cast("decimal(18,6)"), (largest * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(18,6)"))


def rate(n: Column, d: Column) -> Column:
    """n / d, 0 when there is nothing to divide by."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d.cast("double"))


def defined_rate(n: Column, d: Column) -> Column:
    """n / d, null when there is nothing to divide by."""
    return F.when(d != 0, n.cast("double") / d.cast("double"))


def wilson(successes: Column, n: Column, upper: bool) -> Column:
    """95 % score bound; without observations the upper one is null and the lower one 0."""
    z = 1.959963984540054 if upper else 1.96
    n, p = n.cast("double"), successes.cast("double") / n.cast("double")
    middle = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = (middle + spread if upper else middle - spread) / (1 + z * z / n)
    return F.when(n > 0, bound).otherwise(F.lit(None).cast("double") if upper else F.lit(0.0))


def platt(score: Column, slope: float, offset: float) -> Column:
    return 1 / (1 + F.exp(-(score * slope + offset)))


def logit_affine(p: Column, slope: float, offset: float) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(F.log(q / (1 - q)) * slope + offset)))


def intersection(a: list[Column], b: list[Column]) -> Column:
    """Common area of two boxes (x0, y0, x1, y1)."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return w * h


def area(a: list[Column]) -> Column:
    return F.greatest(a[2] - a[0], F.lit(0.0)) * F.greatest(a[3] - a[1], F.lit(0.0))


def intersection_over_union(a: list[Column], b: list[Column]) -> Column:
    both = intersection(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def containment(a: list[Column], b: list[Column]) -> Column:
    """Part of ``b`` that lies in ``a``."""
    return F.when(area(b) > 0, intersection(a, b) / area(b)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 if either is all zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the parts that aren't null, weights rescaled to them; null if there are none; 1 at most."""
    total = weight = F.lit(0.0)
    for value, w in parts:
        total = total + F.coalesce(value * w, F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), w).otherwise(0.0)
    return F.when(weight > 0, F.least(F.lit(1.0), total / weight))


def hamming_hex(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))
