"""All registered queries of the engine."""

from __future__ import annotations

from eventloom.plans import evidence, panel, records, serving, strategy, text
from eventloom.plans.base import Query

MODULES = (panel, evidence, strategy, text, records, serving)


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.REG.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.REG.sql.items()}
