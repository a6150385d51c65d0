"""Tidemark: a PySpark-native engine for news-driven market signals."""

__version__ = "0.1.0"
