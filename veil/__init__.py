"""Veil: find, mask and restore personal data in text with PySpark."""

__version__ = "0.1.0"
