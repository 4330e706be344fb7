"""Registered queries of the table engine."""

from .plans import events, functions, lifecycle

QUERIES = {**events.QUERIES, **lifecycle.QUERIES, **functions.QUERIES}
ORACLE_SQL = {**events.SQL, **lifecycle.SQL, **functions.SQL}
