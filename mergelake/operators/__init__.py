"""Operators on tables and change records."""
