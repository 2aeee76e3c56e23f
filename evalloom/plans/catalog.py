"""All core queries by name, and their SQL."""

from __future__ import annotations

from evalloom.plans import aggregates, effects, general, histories, logs, rankings, reports, scalars, stepwise_sql, streams

_PARTS = (general, scalars, effects, aggregates, histories, rankings, logs, reports, streams, stepwise_sql)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
SQL = {k: v for part in _PARTS for k, v in part.SQL.items()}
