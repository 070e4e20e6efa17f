"""All queries by name, and the equivalent SQL of each."""

from __future__ import annotations

from . import baseline, drawing, entity, evaluation, evidence, footprint, geometry, holdout, identity, intake, merge, packages, records, retrieval, state, text

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (geometry, retrieval, text, evidence, state, evaluation, entity, packages, records, identity, footprint, drawing, merge, holdout, intake, baseline):
    QUERIES |= _module.REGISTRY.queries
    SQL |= _module.REGISTRY.sql
