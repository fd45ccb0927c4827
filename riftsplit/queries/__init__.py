"""Registered queries: each runs an operator over whole driver tables, with SQL to check it where SQL can say it."""

from riftsplit.queries import audit, clean, features, grid, metrics, similarity, sources, splits, training  # noqa: F401
from riftsplit.queries.base import QUERIES, SQL  # noqa: F401
