"""streaming of the log engine."""
