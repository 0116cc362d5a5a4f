"""The registered queries."""

from .registry import ORACLES, QUERIES
from . import control, documents, extraction, landing, messages, pages, reports, streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
