"""The query catalogue: each family has QUERIES (Spark) and ORACLES (SQL for another engine on the same tables)."""

from __future__ import annotations

from . import annotating, chunks, enriching, matching, structure, tables, text

FAMILIES = (text, structure, matching, annotating, chunks, tables, enriching)

QUERIES = {k: v for f in FAMILIES for k, v in f.QUERIES.items()}
ORACLES = {k: v for f in FAMILIES for k, v in f.ORACLES.items()}
