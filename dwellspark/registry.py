"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from .plans import candidates, daily, inputs, metrics, models, patterns, places, series

FAMILIES = [f.family for f in (inputs, daily, places, candidates, patterns, series, metrics, models)]
QUERIES = {name: q for f in FAMILIES for name, q in f.queries.items()}
ORACLE_SQL = {name: s for f in FAMILIES for name, s in f.sql.items()}
