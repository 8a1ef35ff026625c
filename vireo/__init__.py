"""Vireo: a PySpark-native engine for curating very large media and text collections."""

__version__ = "0.1.0"
