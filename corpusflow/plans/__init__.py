"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from corpusflow.plans import cleaning, dialogue, events, formats, pages, vectors
from corpusflow.plans.registry import QUERIES, SQL
from corpusflow.plans.vectors import flagship

__all__ = ["cleaning", "dialogue", "events", "flagship", "formats", "oracle_sql", "pages", "queries", "vectors"]


def queries():
    return QUERIES


def oracle_sql():
    return SQL
