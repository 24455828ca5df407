"""The registered queries, and the same as SQL."""

from . import catalog_queries, lineage_queries, record_queries, table_queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "catalog_queries", "lineage_queries", "record_queries", "table_queries"]
