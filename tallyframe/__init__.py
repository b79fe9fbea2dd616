"""Keyed comparison of two tables on Spark."""

from .operators.compare import compare
from .plans.result import ColumnInfo, DiffResult, Status, Summary

__version__ = "0.1.0"
__all__ = ["ColumnInfo", "DiffResult", "Status", "Summary", "__version__", "compare"]
