"""Columns over texts and paths."""
