"""All registered queries: importing this module fills the registry."""

from . import analysis_queries, domain_queries, grid_queries, relation_queries, stage_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analysis_queries", "domain_queries", "grid_queries", "relation_queries", "stage_queries"]
