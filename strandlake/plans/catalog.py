"""Every query of the engine by name, with the SQL that checks it."""

from __future__ import annotations

from strandlake.plans import annotations, arrivals, calling, calls, documents, observations, panels, planted, reads, truth  # noqa: F401  they register their queries
from strandlake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
