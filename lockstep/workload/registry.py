"""All registered queries and oracles by operator id."""

from __future__ import annotations

from lockstep.workload import documents, events, live, tables

_PARTS = [documents, events, tables, live]
QUERIES = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
