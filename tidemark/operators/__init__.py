"""Operators of the news-signal engine."""
