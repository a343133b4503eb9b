"""Imports every module that registers queries."""

from statvine.plans import asking, bulk, dated, graphs, lookup, pages, records, registry, scalars, searching, walks  # noqa: F401

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
