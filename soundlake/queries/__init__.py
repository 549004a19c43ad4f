"""Queries by name over the derived relations, with DuckDB SQL for those that SQL can express."""

from . import changes, signals, states  # register their queries too
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "changes", "signals", "states"]
