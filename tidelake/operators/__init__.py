"""operators of the maintenance engine."""
