"""All queries of the engine's own operators and their DuckDB twins."""

from __future__ import annotations

from .plans import domain, relational, reports, signals, textual

QUERIES = relational.R.queries | textual.R.queries | reports.R.queries | domain.R.queries | signals.R.queries
ORACLE = relational.R.oracle | textual.R.oracle | reports.R.oracle | domain.R.oracle | signals.R.oracle
