"""Transaction rules and spending analytics as Spark DataFrame operations."""
