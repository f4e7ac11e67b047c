"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from pagewright.plans import auditing, ranking, sourcing

QUERIES: dict = {**ranking.QUERIES, **auditing.QUERIES, **sourcing.QUERIES}
ORACLE: dict = {**ranking.ORACLE, **auditing.ORACLE, **sourcing.ORACLE}
