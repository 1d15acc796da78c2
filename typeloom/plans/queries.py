"""All registered queries."""

from . import q_browse, q_change, q_filter, q_lifecycle, q_read, q_rollup, q_search, q_stream, q_validate  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
