"""Evidence as sets of classes, and policies as alternatives of which one must be there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alternatives(options: list[list[str]]) -> Column:
    return F.array(*(F.array(*map(F.lit, sorted(o))) for o in options))


def satisfied(options: Column, available: Column) -> Column:
    """Whether some alternative is a subset of what is available."""
    return F.exists(options, lambda o: F.size(F.array_except(o, available)) == 0)


def closest_missing(options: Column, available: Column) -> Column:
    """What the nearest alternative still needs: fewest missing, then the smaller alternative, then by name."""
    gaps = F.transform(
        options,
        lambda o: F.struct(F.size(F.array_except(o, available)).alias("n"), F.size(o).alias("of"), F.array_join(F.array_sort(F.array_except(o, available)), "+").alias("missing")),
    )
    return F.array_min(gaps)["missing"]


def coordinated(groups: list[list[str]], blocked: Column) -> Column:
    """Whether two fields of one dependent group are blocked together."""
    out = F.lit(False)
    for g in groups:
        out = out | (F.size(F.array_intersect(F.array(*map(F.lit, g)), blocked)) > 1)
    return out
