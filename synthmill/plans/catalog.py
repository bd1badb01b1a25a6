"""All registered queries."""

from __future__ import annotations

from synthmill.plans import banking, exchange, generation, inference, learn, reporting, reshaping, run  # noqa: F401  (importing registers the queries)
from synthmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
