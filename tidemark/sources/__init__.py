"""Sources of the news-signal engine."""
