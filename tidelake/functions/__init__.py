"""functions of the maintenance engine."""
