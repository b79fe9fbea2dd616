"""Operators for preparing training text, built beside the comparison engine and used by nothing in it."""
