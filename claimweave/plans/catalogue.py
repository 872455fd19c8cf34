"""All registered queries of the claims operators, and the SQL of those it can express."""

from __future__ import annotations

from . import claims, contracts, decisions, evaluation, fields, governance, ladders, localization, matching, pages, readings, records, reference, reports, routing, rules, stores, streams
from .base import Query

_PARTS = (claims.catalogue, fields.catalogue, contracts.catalogue, decisions.catalogue, matching.catalogue, evaluation.catalogue, governance.catalogue, ladders.catalogue, localization.catalogue, records.catalogue, pages.catalogue, readings.catalogue, reference.catalogue, reports.catalogue, routing.catalogue, rules.catalogue, stores.catalogue, streams.catalogue)


def queries() -> dict[str, Query]:
    return {name: f for part in _PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracle_sql().items()}
