"""The registered queries: one for each operator, by name, with SQL that says the same where SQL can."""

from . import aggregates, fate, files, filters, joins, ordering, physics, stream, windows
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "fate", "files", "filters", "joins", "ordering", "physics", "stream", "windows"]
