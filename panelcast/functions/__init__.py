"""functions of the panel engine."""
