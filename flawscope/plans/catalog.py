"""Imports every query module so that all queries are registered."""

from flawscope.plans import queries_features, queries_models, queries_tables  # noqa: F401
