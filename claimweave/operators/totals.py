"""A claim's written total against its written service lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strict_money


def reconciled(claims: DataFrame, lines: DataFrame, claim: str, total: Column, charge: Column) -> DataFrame:
    """``claim``, total, calculated, difference, changed and state of every claim, amounts read strictly.

    MISSING_TOTAL if the total is no amount, MISSING_SERVICE_LINES without
    lines, AMBIGUOUS if a line is no amount, ARITHMETIC_CONFLICT if they don't
    add up to the total to the cent, else EXACT_MATCH, or
    DETERMINISTIC_NORMALIZATION_MATCH if signs or blanks had to be dropped
    from any amount to see it (``changed``). ``claims`` has a row for each
    claim; lines are added up before they are joined.
    """
    charges = lines.select(claim, strict_money(charge).alias("__m")).groupBy(claim).agg(
        F.count(F.lit(1)).alias("__n"), F.count("__m.value").alias("__read"), F.sum(F.col("__m.value").cast("decimal(38,2)")).alias("__sum"), F.bool_or("__m.changed").alias("__changed")
    )
    c = claims.select(claim, strict_money(total).alias("__t")).join(charges, claim, "left")
    known, has, clear = F.col("__t.value").isNotNull(), F.col("__n").isNotNull(), F.col("__n") == F.col("__read")
    calculated = F.when(known & has & clear, F.col("__sum"))
    difference = F.col("__t.value").cast("decimal(38,2)") - calculated
    changed = F.col("__t.changed") | (known & F.coalesce("__changed", F.lit(False)))
    state = (
        F.when(~known, "MISSING_TOTAL").when(~has, "MISSING_SERVICE_LINES").when(~clear, "AMBIGUOUS").when(difference != 0, "ARITHMETIC_CONFLICT")
        .when(changed, "DETERMINISTIC_NORMALIZATION_MATCH").otherwise("EXACT_MATCH")
    )
    return c.select(claim, F.col("__t.value").alias("total"), calculated.alias("calculated"), difference.alias("difference"), changed.alias("changed"), state.alias("state"))
