"""Operators for preparing training data. Nothing outside this package and its tests imports it."""

from riskloom.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
