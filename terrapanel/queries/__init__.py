"""Registered queries: every operator bound to the given tables, with its SQL equivalent where SQL can express it."""

from terrapanel.queries.base import ORACLES, QUERIES  # noqa: F401


def load() -> None:
    """Import the query modules, which fill the registries."""
    from terrapanel.queries import (  # noqa: F401
        aggregates, columns, decision, ensembles, filters, ingest, joins, models, panels, scores, windows)
