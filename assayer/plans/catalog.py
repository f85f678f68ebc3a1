"""The catalog of registered queries, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from assayer.plans import queries_fold, queries_markup, queries_relational, queries_text  # noqa: F401  they register
from assayer.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
