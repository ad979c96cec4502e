"""Query catalogue. Importing the package registers every query."""

from pairloom.plans import catalog, dependence_queries, field_queries, pair_queries, source_queries  # noqa: F401
