"""Whole conversions and their registration for SQL."""
