"""plans of the maintenance engine."""
