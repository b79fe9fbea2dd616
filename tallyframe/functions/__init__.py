"""Types, values and text of compared columns."""
