"""Queries over the test tables, each with the SQL that checks it."""

from workload import cleaning, comparison, quality, relations, texts  # noqa: F401  registers the queries
from workload.registry import ORACLE, QUERIES  # noqa: F401
