"""Comparison: matching rows by key, pairing rows that share one, flagging what differs."""

from .compare import compare

__all__ = ["compare"]
