"""Geospatial multi-criteria scoring as PySpark DataFrame operators."""

__version__ = "0.1.0"
