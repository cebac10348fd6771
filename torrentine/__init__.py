"""Torrentine: a PySpark-native engine for river, water-body and boundary analytics."""

__version__ = "0.1.0"
