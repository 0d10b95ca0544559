"""Relational risk analytics on Spark: rollups, institution partitions, record forests, encoders and score evaluation."""

from riskloom.session import get_session

__all__ = ["get_session"]
