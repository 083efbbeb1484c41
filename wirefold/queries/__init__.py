"""Registered queries over decoded messages, and the SQL that gives the same from the raw tables."""

from wirefold.queries import codec, relational, schemas
from wirefold.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "codec", "relational", "schemas"]
