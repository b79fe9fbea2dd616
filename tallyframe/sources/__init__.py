"""Input frames and row order."""

from .inputs import ordered, to_spark

__all__ = ["ordered", "to_spark"]
