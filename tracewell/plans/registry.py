"""All queries outside the subpackage llm."""

from __future__ import annotations

from tracewell.plans import changes, documents, evaluation, general, governance, links, rules

MODULES = (general, governance, rules, evaluation, changes, documents, links)
FLAGSHIP = "q16_propose"


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
