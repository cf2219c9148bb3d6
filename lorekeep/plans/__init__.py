"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import consolidation, evaluation, facts, lifecycle, recall, scalars, sources, streams

_MODULES = (recall, lifecycle, consolidation, facts, evaluation, scalars, streams, sources)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
