"""All registered queries."""

from . import analytics, catalog, commerce, grounding, metering, retrieval, sync, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
