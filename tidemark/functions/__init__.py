"""Statistics."""
