"""Plans of the news-signal engine."""
