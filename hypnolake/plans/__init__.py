"""Registered queries over the supplied tables."""

from .registry import ORACLES, QUERIES
from . import cohorts, inference, learning, scoring, sequences, signals  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
