"""Named queries over the driver's tables."""

from lodestone.plans import ranking_queries, relation_queries, text_queries  # noqa: F401  (they register themselves)
from lodestone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
