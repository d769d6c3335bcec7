"""Column functions for rule conditions."""
