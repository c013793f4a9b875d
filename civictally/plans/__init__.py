"""Queries over the test tables, one per operator."""

from civictally.plans import checks, found, profile, registry


def core_queries():
    return dict(registry.QUERIES)


def core_sql():
    return dict(registry.SQL)
