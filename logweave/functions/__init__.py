"""functions of the log engine."""
