"""Registered queries of the masking engine and the SQL that recomputes them."""

from veil.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
