"""Registered queries: each runs over whole tables; most have a second formulation as plain SQL."""

from riskloom.catalog.registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
