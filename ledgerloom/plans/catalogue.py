"""All registered queries and their SQL counterparts, by name."""

from __future__ import annotations

from . import q_checks, q_extraction, q_ledgers, q_master, q_parties, q_reports, q_rules, q_state, q_tables, q_vat  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
