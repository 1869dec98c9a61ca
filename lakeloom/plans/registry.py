"""All queries of the core, by module."""

from __future__ import annotations

from lakeloom.plans import contract, curation, edges, extra, general, graph, lookups, more, retrieval, services, text
from lakeloom.streaming import events

MODULES = [retrieval, lookups, graph, curation, text, more, extra, contract, edges, services, events, general]


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.SQL
    return out


def flagship(spark, sf_dir):
    return retrieval.r8_hybrid_search(spark, sf_dir)
