"""All registered queries of the engine and their SQL."""

from tidelog.plans import catalogue, commits, scalars, storage

MODULES = (catalogue, commits, scalars, storage)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: f for m in MODULES for k, f in m.SQL.items()}
