"""All queries of the core and their SQL."""

from __future__ import annotations

from docketry.plans import casework, evidence, training

QUERIES = {**training.QUERIES, **evidence.QUERIES, **casework.QUERIES}
SQL: dict[str, str] = {**training.SQL, **evidence.SQL, **casework.SQL}
