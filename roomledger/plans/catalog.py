"""Imports every query module so the registry is complete."""

from roomledger.plans import report_queries  # noqa: F401
from roomledger.plans import filter_join_queries  # noqa: F401
from roomledger.plans import overlap_queries  # noqa: F401
from roomledger.plans import audit_queries  # noqa: F401
from roomledger.plans import validate_queries  # noqa: F401
from roomledger.plans import state_queries  # noqa: F401
from roomledger.plans import change_queries  # noqa: F401
from roomledger.plans import admission_queries  # noqa: F401
from roomledger.plans import stream_queries  # noqa: F401
from roomledger.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
