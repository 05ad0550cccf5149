"""Queries over the driver's tables: each applies operators, and has the SQL that gives the same rows where SQL can."""

from __future__ import annotations


def all_queries() -> dict:
    from tessera.plans import catalog, folds, layout, matching, parsed, registry, runs, search, sections, validators  # noqa: F401 - importing a module registers its queries

    return dict(registry.QUERIES)


def all_oracles() -> dict:
    all_queries()
    from tessera.plans import registry

    return dict(registry.ORACLES)
