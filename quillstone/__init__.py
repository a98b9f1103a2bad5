"""Quillstone: a PySpark-native engine for profiling, linking and reasoning over disconnected tables."""

__version__ = "0.1.0"
