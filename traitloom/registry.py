"""All queries of the table operators, gathered from the plan modules."""

from __future__ import annotations

from traitloom.plans import MODULES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
