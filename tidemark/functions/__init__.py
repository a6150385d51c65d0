"""Functions of the news-signal engine."""
