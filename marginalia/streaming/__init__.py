"""Incremental runs of the row-wise steps over arriving files."""
