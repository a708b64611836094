"""All queries of the engine with the SQL that states the same result."""

from __future__ import annotations

from panelforge.plans import bulk, generation, interday, intraday, screening, selection, trading

GROUPS = (intraday.R, screening.R, bulk.R, selection.R, generation.R, interday.R, trading.R)
QUERIES = {n: q for g in GROUPS for n, q in g.queries.items()}
ORACLES = {n: q for g in GROUPS for n, q in g.oracles.items()}
