"""All core queries by name, and their SQL."""

from __future__ import annotations

from arborweft.plans import bus, drift, extract, graph, indexing, lineage, links, problems, resolution, routes, search, wiki

_MODULES = [problems, graph, search, resolution, drift, lineage, links, bus, extract, indexing, routes, wiki]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
