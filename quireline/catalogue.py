"""The catalogue of queries, each a function of (spark, folder of tables), and SQL for those that SQL can express."""

from __future__ import annotations

from quireline.plans import documents, joins, lines, ordered, outline, pieces, recognised

_PLANS = (outline, lines, ordered, joins, documents, recognised, pieces)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
