"""Every registered query."""

from tessera.plans import derived_queries, ingest_queries, reading_queries, result_queries, share_queries  # noqa: F401 - each registers its own
from tessera.plans.catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
