"""Registered queries over the driver's tables."""

from . import collocation, columnwise, statistics, texts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "collocation", "columnwise", "statistics", "texts"]
