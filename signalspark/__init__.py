"""Media and signal analytics expressed as Spark DataFrame operations."""
