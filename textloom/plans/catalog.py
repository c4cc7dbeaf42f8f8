"""Every query of the library by name, with the SQL that checks it."""

from __future__ import annotations

from . import editing, runs, sampling, texts, tokens  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
