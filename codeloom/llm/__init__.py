"""Operators for preparing model training text; nothing outside this package imports it."""
