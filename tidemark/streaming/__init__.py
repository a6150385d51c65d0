"""Streaming of the news-signal engine."""
