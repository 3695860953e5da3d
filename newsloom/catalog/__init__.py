"""Registered queries: every operator bound to the given tables, with the
SQL that states the expected result where SQL can state it."""

from newsloom.catalog.base import REGISTRY, Tables
from newsloom.catalog import (  # noqa: F401  (registration on import)
    artifacts, brief, dashboards, dedup, graph, joins, knowledge, ledger, pages, quality, scalars, search, streams,
)

__all__ = ["REGISTRY", "Tables"]
