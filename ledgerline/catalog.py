"""All registered queries of the evaluation engine and their SQL."""

from __future__ import annotations

from ledgerline.plans import contract_queries  # noqa: F401 (registers its queries)
from ledgerline.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
