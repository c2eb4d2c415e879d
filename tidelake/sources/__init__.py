"""sources of the maintenance engine."""
