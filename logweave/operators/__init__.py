"""operators of the log engine."""
