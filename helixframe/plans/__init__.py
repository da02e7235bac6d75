"""Queries and programs on top of the operators; importing the package registers all queries."""

from . import format_queries, function_queries, gene_queries, interval_queries, table_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "format_queries", "function_queries", "gene_queries", "interval_queries", "table_queries"]
