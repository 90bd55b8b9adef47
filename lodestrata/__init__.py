"""Lodestrata: evidence tables, provenance-aware lookups and record hygiene on Spark."""

__version__ = "0.1.0"
