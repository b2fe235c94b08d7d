"""Column builders without state."""
