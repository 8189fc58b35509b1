"""Query operators by family; QUERIES has them all by key."""

from __future__ import annotations

from millrace.operators import aggregates, joins, ordering, scalars, scans, statements, subqueries, windows
from millrace.operators.catalogue import Query

QUERIES: dict[str, Query] = {}
for _family in (scans, joins, aggregates, windows, ordering, subqueries, scalars, statements):
    QUERIES |= _family.QUERIES
