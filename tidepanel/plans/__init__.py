"""All registered queries."""
from . import data, features, performance, stats, streams, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
