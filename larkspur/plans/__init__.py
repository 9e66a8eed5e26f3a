"""Queries over the tables, and their SQL for an independent engine."""

from . import evaluation, modelling, relational, statistics
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "evaluation", "modelling", "relational", "statistics"]
