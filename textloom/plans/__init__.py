"""Queries with their SQL counterparts."""

from . import queries, reports, tools  # noqa: F401  (reports and tools add to the queries)
