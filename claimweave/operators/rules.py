"""Findings from named rules, and gates that list what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(rows: DataFrame, key: str, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """A row (key, rule, severity) for each rule that a row breaks; one pass over ``rows``.

    ``rules``: name to (condition that must hold, severity). An undefined
    condition is a broken one.
    """
    broken = F.array(*(F.struct((~F.coalesce(ok, F.lit(False))).alias("broken"), F.lit(name).alias("rule"), F.lit(severity).alias("severity")) for name, (ok, severity) in sorted(rules.items())))
    return rows.select(key, F.explode(F.filter(broken, lambda r: r["broken"])).alias("f")).select(key, "f.rule", "f.severity")


def failed_gates(gates: dict[str, Column]) -> Column:
    """Names, upper case and in order, of the gates that don't hold; joined by commas."""
    each = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name.upper())) for name, ok in gates.items()))
    return F.array_join(F.array_compact(each), ",")


def missing_required(present: DataFrame, required: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """(entity, field) pairs that are required but not there: an anti-join against what has a value."""
    entities = present.select(entity).distinct()
    wanted = entities.crossJoin(F.broadcast(required.select(*keys)))  # ``required`` is a policy table, a few rows
    return wanted.join(present.select(entity, *keys).distinct(), [entity, *keys], "left_anti")
