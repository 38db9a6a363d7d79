"""Registry of the library's queries and of the SQL each is held against."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES, entry

__all__ = ["ORACLE_SQL", "QUERIES", "entry"]
