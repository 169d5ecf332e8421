"""Whole questions answered in one plan."""
