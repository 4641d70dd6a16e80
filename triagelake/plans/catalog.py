"""Registry of the queries on the driver tables and their SQL."""

from __future__ import annotations

from triagelake.plans import alignment_plans, entity_plans, quality_plans, retrieval_plans, text_plans

QUERIES, ORACLES = {}, {}
for module in (entity_plans, retrieval_plans, text_plans, quality_plans, alignment_plans):
    QUERIES |= module.REGISTRY.queries
    ORACLES |= module.REGISTRY.oracles
