"""All queries of the core and their SQL."""

from tidemark.plans import upkeep_queries as _upkeep  # noqa: F401  (adds its queries)
from tidemark.plans.core_queries import ORACLES, QUERIES

FLAGSHIP = "session_rollups"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
