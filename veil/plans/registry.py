"""All queries of the masking engine and their SQL."""

from veil.plans import detectors, flows, masks, names, span_algebra, stored, stream, threads

MODULES = (detectors, span_algebra, masks, threads, flows, stored, stream, names)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
