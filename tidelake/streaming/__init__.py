"""streaming of the maintenance engine."""
