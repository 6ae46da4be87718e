"""All registered queries."""

from oscilla import emg_queries, event_queries, feature_queries, preset_queries, quality_queries, queries  # noqa: F401  (importing registers them)
from oscilla.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
