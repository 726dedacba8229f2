"""Queries of the package's own operators, by name, and SQL that gives the same rows."""

from __future__ import annotations

from glyphmill.queries import books, conversion, library, markup, modes

QUERIES = conversion.QUERIES | books.QUERIES | markup.QUERIES | modes.QUERIES | library.QUERIES
ORACLE_SQL: dict[str, str] = conversion.ORACLE_SQL | books.ORACLE_SQL | markup.ORACLE_SQL | modes.ORACLE_SQL | library.ORACLE_SQL
