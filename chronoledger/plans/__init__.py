"""Registered queries: the operators over the driver's tables, and the same in SQL."""

from . import activity, audit, completeness, delivery, knowledge, reports

_PARTS = (audit, activity, knowledge, reports, completeness, delivery)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
