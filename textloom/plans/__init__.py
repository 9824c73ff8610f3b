"""The registered queries over the chunking operators, and SQL to hold them against."""

from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
